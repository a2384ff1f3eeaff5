"""Exact duplicates by counting quotient filters.

Every task builds counting quotient filters over the fingerprints of its texts, one for each part of the fingerprint
space: of a fingerprint's other bits the leading ones (the quotient) choose a slot, from which on the sorted
remainders of the same quotient stand as a run; a remainder that occurs more than once is followed by a slot with its
counter. Filters of different tasks merge without loss, as sorted remainders are merged and the counts of equal
ones added up. Fingerprints whose count is above one are routed to a comparison of the whole texts, so that a
collision of fingerprints never joins two different texts.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import join_kind, map_arrow, spread_join, stored, without

#: Fingerprints that one part of the filter is made for, about, and quotients of a part.
PART_FINGERPRINTS, QUOTIENT_BITS = 200_000, 18
#: Fingerprints that a task sorts at a time.
SORTED_FINGERPRINTS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(_normal(t)) for t in b.column(1).to_pylist()]
        fps = np.frombuffer(b"".join(d.digest()[:8] for d in digests), ">i8").astype("i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([d.hexdigest() for d in digests], pa.string())], ["doc_id", "fp", "text_sha256"])


class CountingQuotientFilter:
    """Slots of remainders in runs, one run for each occupied quotient, with counters in the slots.

    A key of quotient_bits + remainder_bits bits has its remainder at the slot of its quotient or, where earlier runs
    reach beyond it, after these. ``occupied`` marks quotients that have a run, ``run_end`` the last slot of a run,
    ``counter`` slots that hold the count of the remainder before them, less one. A key that occurs once has no counter.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int, keys: np.ndarray, counts: np.ndarray):
        """keys: sorted, all different, of type u8; counts: how often each occurs."""
        self.quotient_bits, self.remainder_bits = quotient_bits, remainder_bits
        quotients = (keys >> np.uint64(remainder_bits)).astype("i8")
        width = 1 + (counts > 1)
        before = np.cumsum(width) - width
        first = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(keys) else np.zeros(0, "i8")
        # a run begins at its quotient, or where the run before it ends
        begin = np.maximum.accumulate(quotients[first] - before[first]) + before[first] if len(keys) else first
        size = np.diff(np.r_[first, len(keys)])
        place = before - np.repeat(before[first], size) + np.repeat(begin, size) if len(keys) else before
        n = max(1 << quotient_bits, int(place[-1] + width[-1]) if len(keys) else 0)
        self.slots, self.counter, self.run_end = np.zeros(n, "u8"), np.zeros(n, bool), np.zeros(n, bool)
        self.occupied = np.zeros(1 << quotient_bits, bool)
        self.slots[place] = keys & np.uint64((1 << remainder_bits) - 1)
        many = counts > 1
        self.slots[place[many] + 1] = (counts[many] - 1).astype("u8")
        self.counter[place[many] + 1] = True
        self.occupied[quotients] = True
        last = np.r_[first[1:], len(keys)] - 1 if len(keys) else first
        self.run_end[place[last] + width[last] - 1] = True

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, first slot and last slot of each run: the k-th run end belongs to the k-th occupied quotient."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        return quotients, np.maximum(quotients, np.r_[0, ends[:-1] + 1]) if len(ends) else ends, ends

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their counts."""
        quotients, begins, ends = self._runs()
        size = ends - begins + 1
        place = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = np.repeat(quotients, size)[~self.counter[place]].astype("u8")
        place = place[~self.counter[place]]
        after = np.minimum(place + 1, len(self.slots) - 1)
        counted = (after > place) & self.counter[after]
        return own << np.uint64(self.remainder_bits) | self.slots[place], np.where(counted, self.slots[after].astype("i8"), 0) + 1

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """Both in one: the sorted remainders of each run are merged, the counts of equal ones added up."""
        (x, n), (y, m) = self.items(), other.items()
        at = np.searchsorted(x, y)
        known = at < len(x)
        known[known] = x[at[known]] == y[known]
        n = n.copy()
        n[at[known]] += m[known]
        return CountingQuotientFilter(self.quotient_bits, self.remainder_bits, np.insert(x, at[~known], y[~known]), np.insert(n, at[~known], m[~known]))

    def to_bytes(self) -> bytes:
        """Occupied bits, and the slots in use with their marks; unused slots are not sent."""
        quotients, begins, ends = self._runs()
        size = ends - begins + 1
        place = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
        bits = zlib.compress(np.packbits(self.occupied).tobytes() + np.packbits(self.run_end[place]).tobytes() + np.packbits(self.counter[place]).tobytes(), 1)
        slots = self.slots[place].view("u1").reshape(-1, 8)[:, : -(-self.remainder_bits // 8)]
        return struct.pack("<BBQQ", self.quotient_bits, self.remainder_bits, len(place), len(bits)) + bits + slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        quotient_bits, remainder_bits, n, size = struct.unpack_from("<BBQQ", raw)
        head = struct.calcsize("<BBQQ")
        bits = np.frombuffer(zlib.decompress(raw[head : head + size]), "u1")
        a = -(-(1 << quotient_bits) // 8)
        b = a + -(-n // 8)
        occupied, run_end, counter = (np.unpackbits(x, count=k).astype(bool) for x, k in ((bits[:a], 1 << quotient_bits), (bits[a:b], n), (bits[b:], n)))
        wide = -(-remainder_bits // 8)
        slots = np.zeros((n, 8), "u1")
        slots[:, :wide] = np.frombuffer(raw, "u1", n * wide, head + size).reshape(n, wide)
        slots = slots.view("u8").ravel()
        # the slots in use stand in order; each run belongs to an occupied quotient
        run = np.cumsum(np.r_[False, run_end[:-1]]) if n else np.zeros(0, "i8")
        keys = np.flatnonzero(occupied)[run].astype("u8") << np.uint64(remainder_bits) | slots
        counts = np.ones(n, "i8")
        counts[:-1] += np.where(counter[1:], slots[1:].astype("i8"), 0)
        return cls(quotient_bits, remainder_bits, keys[~counter], counts[~counter])


def _filters(fingerprints: np.ndarray, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
    """The filter of each part, a part being given by the leading bits."""
    keys, counts = np.unique(fingerprints, return_counts=True)
    wide = 64 - bits
    parts = keys >> np.uint64(wide) if bits else np.zeros(len(keys), "u8")
    cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False):
        yield int(parts[a]), CountingQuotientFilter(QUOTIENT_BITS, wide - QUOTIENT_BITS, keys[a:b] & np.uint64(2**wide - 1), counts[a:b])


def _build(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = [(p, f.to_bytes()) for p, f in _filters(np.concatenate([*waiting, np.zeros(0, "u8")]), bits)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([f for _, f in out], pa.binary())], ["part", "filter"])

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False).view("u8"))
            if sum(map(len, waiting)) >= SORTED_FINGERPRINTS:
                yield flush()
        yield flush()

    return build


def _merge(bits: int):
    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, CountingQuotientFilter] = {}  # of two filters of one level comes one of the next
        for b in batches:
            for raw in b.column("filter").to_pylist():
                held, level = CountingQuotientFilter.from_bytes(raw), 0
                while level in levels:
                    held, level = levels.pop(level).merge(held), level + 1
                levels[level] = held
        whole = functools.reduce(CountingQuotientFilter.merge, levels.values())
        keys, counts = whole.items()
        again = counts > 1
        lead = np.uint64(key[0].as_py() << 64 - bits if bits else 0)
        yield pa.RecordBatch.from_arrays([pa.array((keys[again] | lead).view("i8")), pa.array(counts[again])], ["fp", "n"])

    return merge


def repeated_fingerprints(marks: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once; marks: any rows with fp."""
    bits = min(64 - QUOTIENT_BITS - 8, max(0, (n_rows // PART_FINGERPRINTS).bit_length()))
    filters = map_arrow(marks.select("fp"), _build(bits), "part long, filter binary")
    return filters.groupBy("part").applyInArrow(_merge(bits), "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null counts as empty, so null and empty
    texts form one group. The largest id of a group stays; rows that repeat an id are counted one by
    one and share its fate. An empty table gives no rows; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = stored(map_arrow(rows, _fingerprints, "doc_id long, fp long, text_sha256 string"), "fingerprints")
    again = stored(repeated_fingerprints(marks, marks.count()), "repeated")
    ids = stored(marks.join(again.select("fp").hint(join_kind(again)), "fp", "left_semi").select("doc_id").distinct(), "routed")
    body = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    routed = rows.join(ids.hint(join_kind(ids)), rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("doc_id", body.alias("body"))
    # whole texts are the key: equal fingerprints alone do not make a group
    groups = routed.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.select(F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    out = spread_join(marks, groups, "text_sha256", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (keep.eqNullSafe(F.col("doc_id"))).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id repeats; columns as they were.

    Rows with the same doc_id and text are repeats of one row: all stay or all go.
    """
    return without(docs, exact_groups(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"))
