"""Merkle manifest, main text of pages and repair of conversations against plain versions."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import conversations, merkle, ordered, page_text, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle", "op13_conversations"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


# 11 -------------------------------------------------------------------------------------------------------------


def plain_leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_way(levels, i):
    for level in levels[:-1]:
        begin = i - i % 3
        yield [(k == i, level[k]) for k in range(begin, min(begin + 3, len(level)))]
        i //= 3


def plain_audit(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    trees = {s: plain_tree([plain_leaf(r, r["text"]) for r in by[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    for n, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way = [*plain_way(trees[s], i), *plain_way(top, n)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(r, text)
            for run in way:
                folded = sha("".join(folded if own else d for own, d in run))
            proof = sha("".join(d for run in way for own, d in run if not own))
            yield (r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0])


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, at long, item string, digest string, tier int, path string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "i", "d", 2, "p") for r in rows], DOCS).repartition(3)


def check_audit(spark, rows):
    got = merkle.audit(documents(spark, rows)).collect()
    want = list(plain_audit([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_manifest_odd_rows(spark):
    texts = [None, "", "a\nb", "x" * 50_000, "\n\n", "ñ 日本 🙂\n", "tail"]
    rows = [(i, texts[i % 7], "en" if i % 3 else None, [None, "", "b", "ä", "a", "s"][i % 6], i if i % 4 else None) for i in range(40)]
    rows += [(None, "no id\n", "en", "b", 1), (None, None, None, None, None), (3, "same id", "en", "b", 1), *[(77, "again\n", "de", "b", 2)] * 3]
    check_audit(spark, rows)


def test_manifest_of_several_tiers_and_many_sources(spark):
    check_audit(spark, [(i, f"text {i}\n", "en", "one" if i < 800 else f"s{i}", 5) for i in range(1100)])


def test_manifest_small_tables(spark):
    assert merkle.audit(documents(spark, [])).count() == 0
    (only,) = merkle.audit(documents(spark, [(5, "t", "en", "s", 1)])).collect()
    assert only["leaf"] == only["root"] == only["subroot"] and only["proof_sha256"] == sha("") and only["verified"]


@pytest.mark.parametrize("n", [*range(1, 41), 243, 244, 700])
def test_places_of_an_append_log(n):
    """The log is the tree in postorder, and closed-form places find every node and its siblings."""
    leaves = [sha(str(i)) for i in range(n)]
    levels, log = plain_tree(leaves), merkle.append_log(leaves, merkle.height(n))
    assert len(levels) - 1 == merkle.height(n) and log[-1][2] == levels[-1][0]

    def postorder(level, j):
        for k in range(3 * j, min(3 * j + 3, len(levels[level - 1]))) if level else ():
            yield from postorder(level - 1, k)
        yield levels[level][j]

    digests = [d for _, _, d in log]
    assert digests == list(postorder(len(levels) - 1, 0))
    assert all(digests[merkle.position(level, j, n)] == d for level, nodes in enumerate(levels) for j, d in enumerate(nodes))
    for i in range(0, n, 7):
        assert merkle.siblings(digests, i, n, merkle.height(n)) == [(next(k for k, x in enumerate(run) if x[0]), "".join(d for own, d in run if not own)) for run in plain_way(levels, i)]


def test_the_log_over_tiers_is_one_postorder(spark):
    n = 800
    rows = spark.range(n).select(F.lit("s").alias("source"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(1).alias("item"))
    m = merkle.build(rows)
    log = sorted((r["place"], r["digest"]) for r in merkle.log(m.source_tiers).collect())
    want = [d for _, _, d in merkle.append_log([sha(str(i)) for i in range(n)], merkle.height(n))]
    assert log == list(enumerate(want)) and m.root == want[-1]
    spoilt = merkle.proofs(m).withColumn("root", merkle.fold(F.sha2(F.lit("no"), 256), F.col("path")))
    assert spoilt.where(F.col("root") == m.root).count() == 0


def test_numbers_in_keys_over_many_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, "a").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7 % 5000).alias("x")).repartition(7)
    got = ordered.numbered(df, "k", [F.col("x")]).toPandas()
    assert len(got) == 5000 and (got.sort_values(["k", "x"]).groupby("k").cumcount() == got.sort_values(["k", "x"])["at"]).all()


# 12 -------------------------------------------------------------------------------------------------------------

PROSE = "The outer dog reads a long line of the text here, and it goes on for a while, so that it is prose. It has two sentences."
#: Templates that the given pages do not have; what begins with MAIN is the article.
PAGES = [
    f'<html><head><title>T</title><style>x</style></head><body><div id="cookie-banner"><p>We use cookies on this site. {PROSE}</p><button>OK</button></div><header class="site-header"><a href=/>Home</a><p>Slogan of the site</p></header><div id="content"><h1>MAIN Title</h1><div class="entry"><p>MAIN {PROSE}</p><p>MAIN {PROSE}&nbsp;&amp; more</p><ul><li>MAIN item one</li><li>MAIN item two</li></ul><h2>MAIN Sub</h2><p>MAIN {PROSE}</p></div></div><aside class="sidebar"><h3>Related</h3><p>{PROSE}</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>{PROSE}</p></div></section><form action="x"><label>Name</label><input><p>Send us a note.</p></form><footer><p>Copyright 2020. All rights reserved.</p></footer><script>var x="<p>{PROSE}</p>"</script></body></html>',
    f'<body><ul class="menu"><li><a>A</a><li><a>B</a></ul><main><article><header><h1>MAIN head</h1></header><p>MAIN {PROSE}<p>MAIN {PROSE}<div class="ad-slot">{PROSE}</div><p>MAIN {PROSE}<blockquote>MAIN {PROSE}</blockquote></article><section class="reader-comments"><article><p>{PROSE}</p></article></section></main><div class="newsletter"><p>Subscribe to our letter {PROSE}</p></div><div class="footer">x</div>',
    f"<body><div><a>Home</a> <a>News</a></div><div><h1>MAIN head</h1><p>MAIN {PROSE}</p><p>MAIN {PROSE}</p></div><div>© 2020 all rights</div>",
]


@pytest.fixture(scope="module")
def model(spark):
    return page_text.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 5 > 0"))


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(br|/?p|/?h1)>", " ", inner))).split())


def test_held_out_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 5 = 0").collect()
    right = sum(page_text.main_text(r["html"], model) == article(r["html"]) for r in rows)
    assert right >= 0.98 * len(rows)


def test_other_layouts(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 5 = 0").collect()
    found = [(page_text.viterbi(model.emissions(f), near, model.turns.tolist()), want) for r in rows for f, near, want in page_text.examples(r["html"])]
    right = sum(a == b for got, want in found for a, b in zip(got, want, strict=True))
    assert right > 0.99 * sum(len(want) for _, want in found)


@pytest.mark.parametrize("page", PAGES)
def test_templates_that_are_not_in_the_tables(model, page):
    blocks = page_text.blocks_of(page)
    assert page_text.main_text(page, model) == " ".join(b.text for b in blocks if b.text.startswith("MAIN"))


def test_blocks_of_odd_pages():
    text = lambda page: [b.text for b in page_text.blocks_of(page)]
    assert text(None) == text("") == text("<p>") == text("<!-- x --><script>var a='<p>no</p>'</script><style>p{}</style>") == []
    assert text("<p>a<b>b</b> c<br>d<p>e &lt;x&gt; &am &copy; &#x41;&nbsp;f\n\n g</p>h</div></article>") == ["ab c d", "e <x> &am © A f g", "h"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f</table>") == list("abcdef")
    assert text("plain < text & no tags") == ["plain < text & no tags"]
    assert text("<p>" * 3000 + "deep") == ["deep"] and len(text("<div>x" * 2000)) == 2000


def test_viterbi_and_likelihood_against_all_sequences():
    draw = random.Random(3)
    turns = np.array([[[draw.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)])
    weights = np.array([draw.gauss(0, 1) for _ in range(20)])
    pages = [([[draw.randrange(20) for _ in range(3)] for _ in range(n)], [draw.randint(0, 1) for _ in range(n - 1)], [draw.randint(0, 1) for _ in range(n)]) for n in (1, 2, 5, 4, 7)]

    def score(page, labels):
        return sum(weights[f].sum() * y for f, y in zip(page[0], labels, strict=True)) + sum(turns[k][a][b] for k, a, b in zip(page[1], labels, labels[1:], strict=False))

    total = 0.0
    for p in pages:
        every = {ys: score(p, ys) for ys in itertools.product((0, 1), repeat=len(p[0]))}
        assert page_text.viterbi([float(weights[f].sum()) for f in p[0]], p[1], turns.tolist()) == list(max(every, key=every.get))
        total += score(p, p[2]) - np.log(np.exp(list(every.values())).sum())
    arrays = page_text.flattened(pages)
    value, grad, turn = page_text.likelihood(weights, turns, *arrays)
    assert value == pytest.approx(total / 19)
    for i in range(20):
        assert (page_text.likelihood(weights + 1e-6 * (np.arange(20) == i), turns, *arrays)[0] - value) / 1e-6 == pytest.approx(grad[i], abs=1e-4)
    for i in np.ndindex(2, 2, 2):
        more = turns.copy()
        more[i] += 1e-6
        assert (page_text.likelihood(weights, more, *arrays)[0] - value) / 1e-6 == pytest.approx(turn[i], abs=1e-4)


def test_extract_odd_rows(spark, model):
    given = spark.read.parquet(f"{SF}/pages.parquet").first()["html"]
    rows = [(1, "u", None), (2, None, ""), (None, "v", given), (4, "w", given), (4, "w", given), (5, "x", "<p>" + "long words " * 200_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in page_text.extract(df, model).collect()]
    want = article(given)
    assert got[:2] == [(1, "u", "", 0), (2, None, "", 0)] and got[2:5] == [(None, "v", want, len(want)), *[(4, "w", want, len(want))] * 2] and len(got) == 6
    empty = df.limit(0)
    assert page_text.extract(empty).count() == 0 and page_text.extract(df.where("page_id < 3")).count() == 2
    unmarked = df.where("page_id = 5")
    assert page_text.extract(unmarked).first()["n_chars"] == len("long words " * 200_000) - 1  # nothing to learn from


# 13 -------------------------------------------------------------------------------------------------------------


def plain_edits(rows):
    """The least (cost, letters), from the last row back to the first; at most two inserts before a row are of use."""
    ends = {0: (0, ""), 3: (0, ""), 1: (4, "II"), 2: (2, "I")}
    for initial, bad in reversed(rows):
        ways = {}
        for p in range(4):
            found = [(ends[p][0] + 3, "D" + ends[p][1])]
            if bad not in ("b", "d"):
                cut = bad == "t"
                if (p, initial) in conversations.STEPS:
                    cost, letters = ends[conversations.STEPS[p, initial]]
                    found.append((cost + cut, "K" + letters))
                cost, letters = ends[conversations.after(p)]
                found.append((cost + cut + 2, "R" + letters))
            ways[p] = min(found)
        ends = {p: min(ways[p], *[(ways[q][0] + 2 * k, "I" * k + ways[q][1]) for k, q in inserted(p)]) for p in range(4)}
    return ends[0]


def inserted(p):
    for k in (1, 2, 3):
        p = conversations.after(p)
        yield k, p


def test_search_against_a_table_of_costs():
    draw = random.Random(1)
    for _ in range(600):
        rows = [(draw.choice(["u", "a", "u", "a", "s", "t", ""]), draw.choice(["", "", "", "b", "d", "t"])) for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 13, 20]))]
        want = plain_edits(rows)
        assert conversations.Search(rows).cheapest() == want
        for size in (1, 3):
            parts = [conversations.ways(rows[i : i + size]) for i in range(0, len(rows), size)]
            cost, found = conversations.joined(parts)
            assert (cost, "".join(x for _, x in found)) == want or not rows
    rows = [(draw.choice("uas"), draw.choice(["", "", "b", "d", "t"])) for _ in range(400)]
    assert conversations.cheapest_edits(rows) == plain_edits(rows)


def plain_repairs(rows):
    text_of = lambda v: " " if v is None else str(v)
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20, text_of(role), text_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, left in by.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = []
        for i, (_, role, text) in enumerate(left):
            body = text.strip(" \t\n\x0b\x0c\r")
            marks.append((role[:1], "b" if not body else "d" if (role, text) in [r[1:] for r in left[:i]] else "" if body[-1] in ".!?" else "t"))
        turns = {t for t, _, _ in left if t is not None}
        cost, audit = plain_edits(marks)
        out, i = [], 0
        for x in audit:
            if x in "KR":
                out.append([left[i][1] if x == "K" else None, left[i][2]])
            elif x == "I":
                out.append([None, ""])
            i += x != "I"
        first = int(bool(out) and out[0][0] is not None and out[0][0][0] == "s")
        lines = [f"{role or ('user', 'assistant')[(k - first) % 2]}:{text}" for k, (role, text) in enumerate(out)]
        bad = [b for _, b in marks]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad.count("b"), bad.count("d"), bad.count("t"), illegal, cost, audit, sha("\n".join(lines)))


def odd_conversations():
    draw = random.Random(5)
    texts = [None, "", " \t", "Hello there.", "Hello there", "What?", "日本. ", "x" * 20_000 + "!", "again.", "again."]
    rows = [(c, t if draw.random() > 0.05 else None, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice(texts)) for c in [*range(60), None] for t in range(draw.choice([1, 2, 3, 9, 30]))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(1300)] + [(501, 7, "user", "same.")] * 6
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string, key string, place long, seen boolean, chunk long, times int, letters string, n long"


def test_repairs_of_odd_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "k", 1, True, 2, 3, "l", 4) for r in rows], CONVERSATION).repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(plain_repairs(rows), key=key)
    assert sorted(map(tuple, conversations.repairs(df).collect()), key=key) == want
    # every conversation dealt out over tasks
    assert sorted(map(tuple, conversations.repairs(df, large_rows=0).collect()), key=key) == want
    assert conversations.repairs(df.limit(0)).count() == 0


def test_text_conversation_ids_keep_their_type(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("b", 0, "user", "Hi."), (None, 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"] for r in conversations.repairs(df).collect()} == {"a", "b", None}
