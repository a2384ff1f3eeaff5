"""Repair of conversations: the cheapest edits after which roles alternate, found by iterative-deepening A*.

Roles must spell (s?(ua)+)?. Rows are kept, reroled, deleted, or have a message inserted before them; a depth-first search
tries edits in the order of their letters (D, I, K, R) under a cost bound that rises by one from the forced costs, so
that the first accepting path is the answer. A state is the row and the place in the grammar; with how much budget it
failed is kept for all bounds. The letters determine the roles: at every place the grammar needs one of user and assistant.

A long conversation is cut into segments of 81 rows. Each is searched from every place to every place in the grammar, by
the same search, and the segments are joined from left to right. As a path through a segment has one letter D, K or R per
row and ends with one, no such path begins another, so that the least letters of the parts are the least of the whole.

Conversations of up to LARGE_ROWS rows and LARGE_BYTES bytes are each repaired in one task. Larger ones are dealt out by
ranges and their segments searched wherever they lie; a single task then only joins segments (81 times fewer
rows) and, for the digest, which is sequential by its nature, streams repaired text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import join_kind, map_arrow, spread_join, stored

#: Rows of a segment; rows and bytes beyond which a conversation is dealt out over tasks.
SEGMENT, LARGE_ROWS, LARGE_BYTES = 81, 1000, 16 << 20
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: Places in the grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEEDED = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
#: What is inserted at the end, by the place that the rows lead to.
TAIL = ("", "II", "I", "")
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault(text: str, seen: bool) -> str:
    """b blank, d a repeat, t cut off, or nothing; the first counts."""
    body = text.rstrip(SPACE)
    return "b" if not body else "d" if seen else "" if body[-1] in ".!?" else "t"


def after(place: int) -> int:
    return STEPS[place, NEEDED[place][0]]


class Search:
    """Searches through rows (role initial, fault) that end in one place of the grammar, or, without a goal, in an accepting one."""

    def __init__(self, rows: list[tuple[str, str]], goal: int | None = None):
        self.rows, self.goal, self.failed = rows, goal, {}
        self.least = [0] * (len(rows) + 1)  # costs that no path avoids
        for i in reversed(range(len(rows))):
            initial, bad = rows[i]
            forced = DELETE if bad in ("b", "d") else (CUT if bad else 0) + (0 if initial in ("s", "u", "a") else REROLE)
            self.least[i] = self.least[i + 1] + forced

    def edits(self, i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, row, place) in the order of letters."""
        if i == len(self.rows):
            if self.goal is None:  # a part ends with an edit of its last row
                yield "I", INSERT, i, after(place)
            return
        initial, bad = self.rows[i]
        yield "D", DELETE, i + 1, place
        yield "I", INSERT, i, after(place)
        if bad not in ("b", "d"):
            cut = CUT if bad else 0
            if (place, initial) in STEPS:
                yield "K", cut, i + 1, STEPS[place, initial]
            yield "R", REROLE + cut, i + 1, after(place)

    def within(self, entry: int, bound: int) -> str | None:
        """The first accepting path of a depth-first search, without recursion."""
        stack, path = [(0, entry, bound, self.edits(0, entry))], []
        if self.ends(0, entry):
            return ""
        while stack:
            i, place, left, more = stack[-1]
            for letter, cost, j, to in more:
                rest = left - cost
                if rest < self.least[j] or self.failed.get((j, to), -1) >= rest:
                    continue
                path.append(letter)
                if self.ends(j, to):
                    return "".join(path)
                stack.append((j, to, rest, self.edits(j, to)))
                break
            else:
                stack.pop()
                self.failed[i, place] = max(left, self.failed.get((i, place), -1))
                if path:
                    path.pop()
        return None

    def ends(self, i: int, place: int) -> bool:
        return i == len(self.rows) and (place in (0, 3) if self.goal is None else place == self.goal)

    def reaches(self, entry: int) -> bool:
        if self.goal == 0:
            return entry == 0
        if self.goal == 1:
            return entry == 1 or entry == 0 and any(r == "s" and bad in ("", "t") for r, bad in self.rows)
        return True

    def cheapest(self, entry: int = 0) -> tuple[int, str] | None:
        if not self.reaches(entry):
            return None
        bound = self.least[0]
        while (path := self.within(entry, bound)) is None:
            bound += 1
        return bound, path


def ways(rows: list[tuple[str, str]], entries: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, letters): the cheapest path between each two places, through a segment."""
    out = []
    for goal in range(4):
        search = Search(rows, goal)
        out += [(entry, goal, *found) for entry in entries if (found := search.cheapest(entry))]
    return out


def joined(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest edits, and for each segment where it begins in the grammar and its letters; the last has what is inserted at the end."""
    best = {0: (0, 0, None)}  # place -> cost, rank of the letters so far, (entry, letters, what was before)
    for found in segments:
        new: dict[int, tuple] = {}
        for entry, to, cost, letters in found:
            if entry in best:
                total, rank, trail = best[entry]
                key = (total + cost, rank, letters)
                if to not in new or key < new[to][0]:
                    new[to] = (key, (entry, letters, trail))
        ranks = {to: n for n, to in enumerate(sorted(new, key=lambda to: new[to][0][1:]))}
        best = {to: (key[0], ranks[to], trail) for to, (key, trail) in new.items()}
    place = min(best, key=lambda p: (best[p][0] + INSERT * len(TAIL[p]), best[p][1]))
    cost, _, trail = best[place]
    parts, tail = [], TAIL[place]
    while trail:
        entry, letters, trail = trail
        parts.append((entry, letters + tail))
        tail = ""
    return cost + INSERT * len(TAIL[place]), parts[::-1]


def apply(rows: list[tuple[str, str]], letters: str, place: int = 0) -> tuple[list[str], int]:
    """The lines role:text that the edits make of rows (role, text), and the place in the grammar they lead to."""
    out, i = [], 0
    for x in letters:
        if x == "D":
            i += 1
            continue
        role, text = rows[i] if x == "K" else (NEEDED[place], "" if x == "I" else rows[i][1])
        out.append(f"{role}:{text}")
        place, i = STEPS[place, role[0]], i + (x != "I")
    return out, place


def cheapest_edits(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and letters for rows (role initial, fault) of one conversation."""
    if len(rows) <= SEGMENT:
        return Search(rows).cheapest()
    cost, parts = joined([ways(rows[i : i + SEGMENT], (0,) if not i else (0, 1, 2, 3)) for i in range(0, len(rows), SEGMENT)])
    return cost, "".join(letters for _, letters in parts)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """Figures of one conversation from its rows (turn, role, text) in order."""
    seen, marks = set(), []
    for _, role, text in rows:
        marks.append((role[:1], fault(text, (role, text) in seen)))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, letters = cheapest_edits(marks)
    lines, _ = apply([r[1:] for r in rows], letters)
    bad = [b for _, b in marks]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return {"gaps": gaps, "blank": bad.count("b"), "duplicate": bad.count("d"), "truncated": bad.count("t"), "illegal": _illegal([x for x, _ in marks]), "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], cols: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted batches, one group at a time."""
    held, rows = None, []
    for b in batches:
        for key, row in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), zip(*(b.column(c).to_pylist() for c in cols), strict=True), strict=True):
            if key != held:
                if held is not None:
                    yield held, rows
                held, rows = key, []
            rows.append(row)
    if held is not None:
        yield held, rows


def _in_batches(rows: Iterator[dict], names: list[str], types: dict[str, pa.DataType], size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], types.get(c, pa.int64())) for c in names], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in held], types.get(c, pa.int64())) for c in names], names)


_NAMES = ["key", *COUNTS, "audit", "repaired_sha256"]
_TYPES = {"key": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for (key,), rows in _groups(batches, ("key",), ("turn", "role", "text", "times")):
            yield {"key": key} | repair([r[:3] for r in rows for _ in range(r[3])])

    yield from _in_batches(each(), _NAMES, _TYPES)


def damaged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, times): each row as the rule damages it, and how often it stands there (0: dropped)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select(_key().alias("key"), "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))


#: Ascending, nulls first.
ORDER = ("key", "turn", "role", "text")


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for (key, chunk), rows in _groups(batches, ("key", "chunk"), ("role", "text", "seen")):
            marks = [(role[:1], fault(text, seen)) for role, text, seen in rows]
            bad, initials = [b for _, b in marks], [x for x, _ in marks]
            found = [dict(zip(("entry", "exit", "cost", "letters"), w, strict=True)) for w in ways(marks)]
            yield {"key": key, "chunk": chunk, "blank": bad.count("b"), "duplicate": bad.count("d"), "truncated": bad.count("t"), "illegal": _illegal(initials), "first": initials[0], "last": initials[-1], "ways": found}

    way = pa.list_(pa.struct([("entry", pa.int64()), ("exit", pa.int64()), ("cost", pa.int64()), ("letters", pa.string())]))
    yield from _in_batches(each(), ["key", "chunk", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"], {"key": pa.string(), "first": pa.string(), "last": pa.string(), "ways": way}, 50)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment with its letters and where it begins in the grammar, and one without a segment with the sums."""

    def each() -> Iterator[dict]:
        none = dict.fromkeys((*COUNTS[1:], "audit"))
        for (key,), rows in _groups(batches, ("key",), ("chunk", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways")):
            cost, parts = joined([[(w["entry"], w["exit"], w["cost"], w["letters"]) for w in r[7]] for r in rows])
            for r, (entry, letters) in zip(rows, parts, strict=True):
                yield none | {"key": key, "chunk": r[0], "entry": entry, "letters": letters}
            sums = dict(zip(COUNTS[1:5], (sum(r[k] for r in rows) for k in (1, 2, 3, 4)), strict=True))
            sums["illegal"] += sum(a[6] + b[5] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            yield sums | {"key": key, "chunk": None, "entry": None, "letters": None, "cost": cost, "audit": "".join(letters for _, letters in parts)}

    yield from _in_batches(each(), ["key", "chunk", "entry", "letters", *COUNTS[1:], "audit"], {"key": pa.string(), "letters": pa.string(), "audit": pa.string()}, 50)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each segment, joined; segments without lines give no row."""

    def each() -> Iterator[dict]:
        for (key, chunk), rows in _groups(batches, ("key", "chunk"), ("role", "text", "entry", "letters")):
            lines, _ = apply([r[:2] for r in rows], rows[0][3], rows[0][2])
            if lines:
                yield {"key": key, "chunk": chunk, "lines": "\n".join(lines)}

    yield from _in_batches(each(), ["key", "chunk", "lines"], {"key": pa.string(), "lines": pa.string()}, 20)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each key as they stream by; nothing of them is kept."""
    held, sha, out = None, None, []
    for b in batches:
        for key, lines in zip(b.column("key").to_pylist(), b.column("lines").to_pylist(), strict=True):
            if key != held:
                if sha:
                    out.append((held, sha.hexdigest()))
                held, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(lines.encode())
    if sha:
        out.append((held, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], ["key", "repaired_sha256"])


def _dealt_out(rows: DataFrame) -> DataFrame:
    """RESULT for conversations that are too large for one task; rows as damaged() gives them."""
    copies = rows.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "_copy")
    dealt = copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("place", F.monotonically_increasing_id())
    placed = stored(dealt.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "turns")
    first = stored(placed.groupBy("key", "digest").agg(F.min("place").alias("place")).select("place", F.lit(False).alias("seen")), "first-turns")
    marked = placed.join(first.hint("merge"), "place", "left").select("key", "turn", "role", "text", "place", F.coalesce("seen", F.lit(True)).alias("seen"), F.floor(F.col("place") / SEGMENT).alias("chunk"))
    marked = stored(marked, "marked-turns")
    by_chunk = lambda df: df.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place")
    way = "array<struct<entry: long, exit: long, cost: long, letters: string>>"
    segments = stored(map_arrow(by_chunk(marked), _segment, f"key string, chunk long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways {way}"), "segments")
    sums = ", ".join(f"{c} long" for c in COUNTS[1:])
    solved = stored(map_arrow(segments.repartition("key").sortWithinPartitions("key", "chunk"), _solve, f"key string, chunk long, entry long, letters string, {sums}, audit string"), "letters")
    letters = solved.where("chunk is not null").select("key", "chunk", "entry", "letters")
    lines = map_arrow(by_chunk(marked.join(letters.hint("merge"), ["key", "chunk"])), _lines, "key string, chunk long, lines string")
    digests = map_arrow(lines.repartition("key").sortWithinPartitions("key", "chunk"), _digest, "key string, repaired_sha256 string")
    turns = marked.groupBy("key", "turn").count().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = solved.where("chunk is null").join(turns.hint("merge"), "key").join(digests.hint("merge"), "key", "left")
    return found.select("key", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def repairs(rows: DataFrame, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """Damages conversations (conv_id, turn, role, text), repairs them and gives figures, letters and digest per conv_id.

    Nulls in any column are one space where text is asked for; null conv_ids are one conversation, null turns come first
    and do not count for gaps. Rows with equal turns are in the order of role and text. A conversation of which
    nothing is left has zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are not read.
    """
    marked = damaged(rows)
    size = stored(marked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("times").alias("most")), "sizes")
    large = size.where((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).where("most > 0").select("key")
    small = marked.join(large.hint(join_kind(large)), "key", "left_anti")
    out = map_arrow(small.repartition("key").sortWithinPartitions(*ORDER), _whole, RESULT)
    if not large.isEmpty():
        out = out.unionAll(_dealt_out(spread_join(marked, large, "key")))
    return out.withColumn("conv_id", F.when(F.col("key") != "", F.substring("key", F.lit(2), F.length("key"))).cast(rows.schema["conv_id"].dataType)).select("conv_id", *COUNTS, "audit", "repaired_sha256")
