"""SQL with the same rows as some of the registered queries."""

from __future__ import annotations

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII expression, bit by bit."""
    step = "list_reduce(list_concat([c], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_extract(list_transform([xor(a, b)], lambda c: {step}), 1)), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of ternary trees over leaves (src, i, d), as name (src, lvl, i, d)."""
    return f"""{name}(src, lvl, i, d) AS (
             SELECT src, 0, i, d FROM {leaves}
             UNION ALL
             SELECT src, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
             FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM {name}) WHERE n > 1 GROUP BY src, lvl, i // 3)"""


def _runs(name: str, tree: str, leaves: str) -> str:
    """For each leaf (src, leaf) and level the digests left and right of its node in the run, as name (src, leaf, lvl, l, r)."""
    return f"""{name} AS (
             SELECT a.src, a.i AS leaf, t.lvl,
                    coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < a.i // (3 ** t.lvl)::BIGINT), '') AS l,
                    coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > a.i // (3 ** t.lvl)::BIGINT), '') AS r
             FROM {leaves} a JOIN {tree} t ON t.src = a.src AND t.i // 3 = a.i // (3 ** (t.lvl + 1))::BIGINT
             WHERE t.lvl < (SELECT max(lvl) FROM {tree} h WHERE h.src = a.src) GROUP BY a.src, a.i, t.lvl)"""


MERKLE = f"""
        WITH RECURSIVE
             docs AS (SELECT doc_id, coalesce('s' || source, '') AS src, {_leaf("text")} AS d,
                             CASE WHEN coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0, FALSE) THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS copy FROM documents),
             leaves AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM docs),
             {_tree("tree", "leaves")},
             roots AS (SELECT src, arg_max(d, lvl) AS subroot, row_number() OVER (ORDER BY encode(src)) - 1 AS i FROM tree GROUP BY src),
             tops AS (SELECT 0 AS src, i, subroot AS d FROM roots),
             {_tree("top", "tops")},
             {_runs("below", "tree", "leaves")},
             {_runs("above", "top", "tops")},
             steps AS (SELECT src, leaf, lvl, l, r FROM below
                       UNION ALL SELECT b.src, b.i, 1000 + a.lvl, a.l, a.r FROM leaves b JOIN roots USING (src) JOIN above a ON a.leaf = roots.i),
             paths AS (SELECT src, leaf, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS run FROM steps GROUP BY src, leaf),
             folded AS (SELECT a.*, coalesce(proof, '') AS proof, subroot, (SELECT arg_max(d, lvl) FROM top) AS root,
                               list_reduce(list_concat([copy], coalesce(run, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
                        FROM leaves a JOIN roots USING (src) LEFT JOIN paths p ON p.src = a.src AND p.leaf = a.i)
        SELECT doc_id, d AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def _add(x: str, cost: int | str, letters: str) -> str:
    """A path (four digits of cost, letters) that goes on; one that does not exist stays so."""
    return f"(CASE WHEN {x} = '~' THEN '~' ELSE lpad(CAST(CAST(left({x}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({x}, 7) || '{letters}' END)"


def _when(test: str, x: str) -> str:
    return f"(CASE WHEN {test} THEN {x} ELSE '~' END)"


def _row_step() -> str:
    """The cheapest paths to the four places of the grammar after one more row b (its role initial and its fault), from those before it, a."""
    c = [f"split_part(a, '|', {k})" for k in (1, 2, 3, 4)]
    inner = f"[{c[0]}, {c[1]}, least({c[2]}, {', '.join(_add(c[k], 2, 'I') for k in (0, 1, 3))}), least({c[3]}, {_add(c[2], 2, 'I')}, {_add(c[0], 4, 'II')}, {_add(c[1], 4, 'II')})]"
    p = [f"list_extract(p, {k})" for k in (1, 2, 3, 4)]
    live, cut = "b[-1:] NOT IN ('b', 'd')", "CAST(b[-1:] = 't' AS INT)"
    is_ = lambda role: f"{live} AND left(b, 1) = '{role}'"
    new = [
        _add(p[0], 3, "D"),
        f"least({_add(p[1], 3, 'D')}, {_when(is_('s'), _add(p[0], cut, 'K'))})",
        f"least({_add(p[2], 3, 'D')}, {', '.join(_when(is_('u'), _add(p[k], cut, 'K')) + ', ' + _when(live, _add(p[k], f'2 + {cut}', 'R')) for k in (0, 1, 3))})",
        f"least({_add(p[3], 3, 'D')}, {_when(is_('a'), _add(p[2], cut, 'K'))}, {_when(live, _add(p[2], f'2 + {cut}', 'R'))})",
    ]
    return f"list_extract(list_transform([{inner}], lambda p: {" || '|' || ".join(new)}), 1)"


_OR_SPACE = "coalesce(CAST({} AS VARCHAR), ' ')".format
CONVERSATIONS = f"""
        WITH marked AS (SELECT conv_id, turn, coalesce('c' || conv_id, '') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(f"({_OR_SPACE('conv_id')} || ':' || {_OR_SPACE('turn')})")} % 20 AS kind FROM conversations),
             damaged AS (SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked),
             placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i FROM damaged),
             seen AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
                             lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS last FROM placed),
             faults AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault FROM seen),
             sums AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                             count(*) FILTER (i > 1 AND last || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                             list_reduce(list_concat(['000000|~|~|~'], list(rpad(left(role, 1), 1, ' ') || fault ORDER BY i)), lambda a, b: {_row_step()}) AS ends FROM faults GROUP BY k),
             best AS (SELECT *, least(split_part(ends, '|', 1), split_part(ends, '|', 4), {_add("split_part(ends, '|', 3)", 2, "I")}, {_add("split_part(ends, '|', 2)", 4, "II")}) AS way FROM sums),
             letters AS (SELECT k, substr(way, 7) AS audit, generate_subscripts(string_split(substr(way, 7), ''), 1) AS n FROM best WHERE length(way) > 6),
             edits AS (SELECT *, audit[n] AS e, length(replace(audit[:n], 'I', '')) AS i, length(replace(audit[:n], 'D', '')) AS m FROM letters),
             made AS (SELECT e.k, e.m, e.e, CASE e.e WHEN 'I' THEN '' ELSE f.text END AS text, CASE e.e WHEN 'K' THEN f.role END AS role,
                             max(CASE WHEN e.e = 'K' AND e.m = 1 AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.k) AS sys
                      FROM edits e LEFT JOIN faults f ON f.k = e.k AND f.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'),
             repaired AS (SELECT k, sha256(string_agg(coalesce(role, CASE WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY m)) AS sha FROM made GROUP BY k)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(CAST(left(way, 6) AS BIGINT), 0) AS cost, coalesce(substr(way, 7), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, k FROM marked) c LEFT JOIN best USING (k) LEFT JOIN repaired USING (k)"""
