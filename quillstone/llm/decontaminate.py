"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is collapsed. An item of m characters may be
found with up to k = m // 15 edits, so that items of fewer than 15 characters must occur as they are. Cut into k + 1 pieces, at least one piece of any such occurrence is
intact, so exact hits of pieces (an Aho-Corasick automaton over all pieces) are candidates, and the stretch
around each hit is verified with Myers' bit-parallel approximate matching.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import map_arrow, without

#: An item may have one edit in this many characters.
CHARS_PER_EDIT = 15
#: Characters of test items in one automaton. More items are taken in several passes over the texts.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places; an item has more characters than edits."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text that is closest to item; of equals the first end. Myers 1999."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, (m, 0)
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # a match may begin anywhere: no edit is charged at the start
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


class ItemIndex:
    def __init__(self, texts: list[str]):
        """Normalised texts of items; hits() names them by their places in the list."""
        self.items = {i: (t, len(t) // CHARS_PER_EDIT) for i, t in enumerate(texts) if t}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (t, k) in self.items.items():
            for place, piece in pieces(t, k):
                at.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """The closest occurrence within its budget, item by item: (distance, end in the normalised text)."""
        if not self.items:
            return {}
        seen: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, place in where:
                seen.setdefault(i, []).append(end + 1 - size - place)  # where the item would begin
        found = {}
        for i, begins in seen.items():
            item, k = self.items[i]
            if (p := text.find(item)) >= 0:
                found[i] = (0, p + len(item))
                continue
            spans: list[list[int]] = []  # stretches that an occurrence through a hit can reach; near ones are joined
            for b in sorted(set(begins)):
                a, z = max(0, b - k), b + len(item) + k
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
            best = min((d, a + e) for a, z in spans for d, e in [best_end(item, text[a:z])])
            if best[0] <= k:
                found[i] = best
        return found


@functools.lru_cache(maxsize=1)
def _index(texts: tuple[str, ...]) -> ItemIndex:
    return ItemIndex(list(texts))


def _match(items):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = items.value
        index = _index(texts)
        for b in batches:
            rows = [(d, names[i], e[0], e[1]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for i, e in sorted(index.hits(normal(t)).items())]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc_id", "item_id", "distance", "end"])

    return match


def blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int | None, ...], tuple[str, ...]]]:
    """(ids, normalised texts) of test items in blocks of BLOCK_CHARS characters at most (one item, if it alone is longer).

    The driver holds one block at a time.
    """
    names, texts, chars = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").distinct().toLocalIterator():
        t = normal(r.text)
        if texts and chars + len(t) > BLOCK_CHARS:
            yield tuple(names), tuple(texts)
            names, texts, chars = [], [], 0
        if t:
            names.append(r.item_id)
            texts.append(t)
            chars += len(t)
    if texts:
        yield tuple(names), tuple(texts)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end): the closest occurrence of each test item in each text, if within its budget.

    end counts characters of the lower-cased text with collapsed white space. Null and empty texts or
    items match nothing. An item_id with several texts has a row for each text that is found, and items
    without an id are searched too (item_id null). Rows of docs that repeat give repeated rows. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, end int"
    parts = []
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters
        parts.append(map_arrow(docs.select("doc_id", "text"), _match(held), schema))
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has a test item in it; columns as they were."""
    return without(docs, contamination(docs, benchmark).select("doc_id").distinct())
