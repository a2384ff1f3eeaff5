"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (blanks become U+2581, one is put in front), cut into symbols, and
the adjacent pair with the best score, the leftmost of equals, is merged until no pair is in the
vocabulary: an agenda ordered by (score, position). Symbols that end outside the vocabulary become bytes.
Long chunks have a heap each; the agendas of the short ones of a batch, a few entries each, are arrays that advance
together.

No piece of such a vocabulary has the blank mark after another character, so no merge crosses the place
before a blank mark, and the chunks between those places are encoded on their own. Chunks repeat, so
their results are held in a table of bounded size. All chunks that a table does not hold are compared,
batch by batch, with the sentencepiece library, ids and decoded text alike; a difference fails the job.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow

MARK = "▁"
#: Chunks that a worker remembers in two generations: when the younger one is half of this, it takes the place of the older.
CHUNKS_HELD = 100_000
#: Texts, and their characters, whose agendas are worked off together: arrays of some tens of bytes for each character.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 300, 2_000_000
#: Chunks of more characters are not remembered.
LONGEST_HELD = 64
#: Chunks of more characters are merged with a heap.
LONGEST_ARRAY = 48
#: The rank of a pair that is not in the vocabulary; positions are added to ranks.
NONE = 1 << 62
#: Stands for every character that the vocabulary lacks.
LACKING = (1 << 20) - 1


class MergeEncoder:
    def __init__(self, model_path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has a blank mark inside; chunks cannot be encoded on their own")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.not_spelt = self.silent | set(self.byte_of)
        self.names = [str(i) for i in range(n)]
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.ids_held: dict[str, str] = {}
        #: text of the chunks that are not decoded to themselves
        self.other_text: dict[str, str] = {}
        self.ids_old: dict[str, str] = {}
        self.other_old: dict[str, str] = {}
        # place in the order of scores, best first; equal scores share a place
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.place = np.unique(-scores, return_inverse=True)[1].astype("i8")
        self._pairs()

    def _pairs(self) -> None:
        """Symbols: pieces by id, then the single characters that only occur inside pieces. pairs: left * 2**20 + right to the merged id."""
        self.symbol = dict(self.id_of)
        for p in self.id_of:
            for ch in p:
                self.symbol.setdefault(ch, len(self.pieces) + len(self.symbol))
        self.of_char = np.full(sys.maxunicode + 1, LACKING, "i4")
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        found = sorted((self.symbol[p[:k]] << 20 | self.symbol[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self.pair_keys = np.array([k for k, _ in found] or [-1], "i8")
        self.pair_ids = np.array([i for _, i in found] or [0], "i8")

    @functools.cached_property
    def pair_table(self) -> dict[int, int]:
        """The pairs as a dict, for single look-ups; made only where there is a long chunk."""
        return dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist(), strict=True))

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, -1 where the vocabulary lacks them."""
        keys = left.astype("i8") << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def _rank(self, merged: np.ndarray) -> np.ndarray:
        """Places of merged ids in the order of scores, in the upper bits; NONE where there is none."""
        return np.where(merged >= 0, self.place[np.maximum(merged, 0)] << 32, NONE)

    def _spelt(self, text: str) -> list[int]:
        """Ids of a symbol that is not in the vocabulary: its bytes, or the unknown piece."""
        return [self.byte_id[b] for b in text.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def merge_long(self, chunk: str) -> list[int]:
        """Ids of one chunk: a heap of (score, position) of adjacent pairs, and links between the symbols that are left.

        An entry is stale if a symbol of its pair has been merged since; each merge enters the two pairs that arise.
        """
        symbol = self.of_char[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4")].astype("i8")
        merged = self._merged(symbol[:-1], symbol[1:])
        at = np.flatnonzero(merged >= 0)
        agenda = list(zip(self.place[merged[at]].tolist(), at.tolist(), merged[at].tolist(), strict=True))
        heapq.heapify(agenda)
        held = symbol.tolist()
        n = len(held)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        places, pairs = self.place.tolist(), self.pair_table
        want = {i: new for _, i, new in agenda}  # what each position would become with its right neighbour
        while agenda:
            _, i, new = heapq.heappop(agenda)
            if want.get(i) != new:
                continue
            j = right[i]
            held[i], held[j] = new, -1
            want.pop(j, None)
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a >= 0 and b < n:
                    made = pairs.get(held[a] << 20 | held[b])
                    if made is None:
                        want.pop(a, None)
                    else:
                        want[a] = made
                        heapq.heappush(agenda, (places[made], a, made))
                elif a >= 0:
                    want.pop(a, None)
        out: list[int] = []
        i = 0
        while i < n:
            if held[i] < len(self.pieces):
                out.append(held[i])
            else:
                out += self._spelt(chunk[i : right[i]])
            i = right[i]
        return out

    def merge(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        long = {i: self.merge_long(c) for i, c in enumerate(chunks) if len(c) > LONGEST_ARRAY}
        if not long:
            return self.merge_short(chunks)
        short = iter(self.merge_short([c for i, c in enumerate(chunks) if i not in long]))
        return [long[i] if i in long else next(short) for i in range(len(chunks))]

    def merge_short(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. The agendas of all chunks advance together: in each round every chunk takes
        the best entry of its agenda, the leftmost of equals, and enters the two pairs that arise."""
        if not chunks:
            return []
        text = "".join(chunks)
        size = np.array([len(c) for c in chunks])
        symbol = self.of_char[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        start = np.arange(len(text), dtype="i4")
        done: list[tuple] = []
        # of each symbol with its right neighbour in the chunk: the merged id, and its place in the order of scores
        new = np.full(len(text), -1, "i4")
        new[:-1] = self._merged(symbol[:-1], symbol[1:])
        new[np.cumsum(size) - 1] = -1
        rank = self._rank(new)
        left = size  # symbols of each chunk that is not finished; one goes in each round
        while True:
            best = np.minimum.reduceat(rank + np.arange(len(rank)), np.cumsum(left) - left)
            over = best >= NONE
            if over.any():  # chunks with an empty agenda are finished
                gone = np.repeat(over, left)
                done.append((start[gone], symbol[gone]))
                stay, best, left = ~gone, best[~over], left[~over]
                if not len(left):
                    break
            else:
                stay = np.ones(len(rank), bool)
            at = best & 0xFFFFFFFF
            symbol[at] = new[at]
            stay[at + 1] = False
            at = np.cumsum(stay, dtype="i4")[at] - 1
            start, symbol, new, rank = start[stay], symbol[stay], new[stay], rank[stay]
            left = left - 1
            last = np.cumsum(left) - 1
            ends_chunk = at == last
            new[at[ends_chunk]], rank[at[ends_chunk]] = -1, NONE
            i = np.concatenate([at[~ends_chunk], at[at > last - left + 1] - 1])
            new[i] = made = self._merged(symbol[i], symbol[i + 1])
            rank[i] = self._rank(made)
        start, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start)
        start, symbol = start[order], symbol[order]
        width = np.diff(start, append=len(text))
        ends = np.searchsorted(start, np.cumsum(size)).tolist()
        ids = symbol.tolist()
        odd = np.flatnonzero(symbol >= len(self.pieces)).tolist()  # not in the vocabulary: bytes, or unknown
        if odd:
            spelt = {k: self._spelt(text[start[k] : start[k] + width[k]]) for k in odd}
            begin = [0, *ends[:-1]]
            return [[i for k in range(a, b) for i in (spelt.get(k) or (ids[k],))] for a, b in zip(begin, ends, strict=True)]
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def spell(self, ids: list[int]) -> str:
        """The pieces in a row, blank marks as blanks; bytes that are not UTF-8 become U+FFFD."""
        if self.not_spelt.isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.silent:
                out += self.pieces[i].replace(MARK, " ").encode()
        return out.decode("utf-8", "replace")

    def _learn(self, fresh: list[str]) -> None:
        """Encodes chunks that are not held and compares each with the library."""
        own = self.merge(fresh)
        # the library puts the first mark in front itself, and drops it where nothing follows
        theirs = self.library.encode([c[1:].replace(MARK, " ") for c in fresh], num_threads=1)
        for c, ids, lib in zip(fresh, own, theirs, strict=True):
            if ids != lib and c != MARK:
                raise ValueError(f"the chunk {c!r} has ids {ids}, the library gives {lib}")
            self.ids_held[c] = ",".join(map(self.names.__getitem__, ids))
        # pieces that are spelt as they stand make up their chunk; the comparison below would tell otherwise
        texts = [c.replace(MARK, " ") for c in fresh]
        apart = self.not_spelt.isdisjoint
        for k, ids in enumerate(own):
            if not apart(ids):
                t = self.spell(ids)
                if t != texts[k]:
                    self.other_text[fresh[k]] = texts[k] = t
        # a chunk begins with a blank mark, so that bytes of two chunks do not meet
        spelt = "".join(texts)
        if self.library.decode([i for ids in own for i in ids]) != spelt.removeprefix(" "):
            wrong = next((c for c, ids, t in zip(fresh, own, texts, strict=True) if self.library.decode(ids) != t.removeprefix(" ")), fresh[0])
            raise ValueError(f"the chunk {wrong!r} is decoded otherwise by the library")

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by commas and the decoded text."""
        parts = []
        for t in texts:
            if "  " in t or t[:1] == " " or t[-1:] == " " or MARK in t:
                parts.append(self.chunks.findall(MARK + t.replace(" ", MARK)))
            else:
                parts.append((MARK + t.replace(" ", f" {MARK}")).split(" ") if t else [])
        if len(self.ids_held) > CHUNKS_HELD // 2:
            self.age()
        missing = set().union(*parts).difference(self.ids_held)
        again = missing & self.ids_old.keys()  # common chunks pass on to the younger generation
        for c in again:
            self.ids_held[c] = self.ids_old[c]
            if c in self.other_old:
                self.other_text[c] = self.other_old[c]
        if fresh := list(missing - again):
            self._learn(fresh)
        out = []
        for p in parts:
            ids = ",".join(map(self.ids_held.__getitem__, p))
            spelt = p if not self.other_text or self.other_text.keys().isdisjoint(p) else [self.other_text.get(c) or c for c in p]
            # chunks that are decoded to themselves have blanks for their marks
            out.append((ids.count(",") + 1 if p else 0, ids, "".join(spelt).replace(MARK, " ")[1:]))
        for c in fresh:
            if len(c) > LONGEST_HELD:
                del self.ids_held[c]
                self.other_text.pop(c, None)
        return out

    def age(self) -> None:
        """The younger generation becomes the older one; one that a few very long texts have blown up is not kept."""
        few = len(self.ids_held) <= CHUNKS_HELD
        self.ids_old, self.other_old = (self.ids_held, self.other_text) if few else ({}, {})
        self.ids_held, self.other_text = {}, {}


@functools.lru_cache(maxsize=1)
def _encoder(model_path: str) -> MergeEncoder:
    """One for all tasks of a worker: reading the vocabulary takes longer than many texts."""
    return MergeEncoder(model_path)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, null as empty, as many together as both bounds allow; a longer text stands alone."""
    some, size = [], 0
    for t in texts:
        if some and (len(some) == TEXTS_AT_ONCE or size + len(t or "") > CHARACTERS_AT_ONCE):
            yield some
            some, size = [], 0
        some.append(t or "")
        size += len(some[-1])
    if some:
        yield some


def _encode(model_path: str, whole: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model_path)
        gc.disable()  # ids are many small lists without cycles, which it would walk again and again
        try:
            for b in batches:
                texts = b.column(1).to_pylist()
                done = []
                for some in _groups(texts):
                    done += coder.encode_batch(some)
                if whole:
                    ids = pa.array([[int(x) for x in d[1].split(",")] if d[1] else [] for d in done], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([d[2] for d in done], pa.string())], ["doc_id", "ids", "decoded"])
                else:
                    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([sha(d[1]) for d in done]), pa.array([sha(d[2]) for d in done])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()
        coder.age()  # the worker goes on to other tasks with one generation

    return encode


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; null texts count as empty.

    No begin or end ids and no sampling. Rows that repeat stay repeated; an empty table gives no rows;
    other columns are not read. model_path must be readable on the executors.
    """
    return map_arrow(docs.select("doc_id", "text"), _encode(model_path, True), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with its lists and texts as SHA-256 values."""
    return map_arrow(docs.select("doc_id", "text"), _encode(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with a column ``name``: the text of the ids, as the library's decode(ids) gives it; null ids count as none.

    A column of that name must not be there yet.
    """
    from pyspark.sql.functions import pandas_udf

    if name in rows.columns:
        raise ValueError(f"rows has a column {name} already")

    @pandas_udf("string")
    def text(series):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return series.map(lambda ids: sp.decode([int(i) for i in ids]) if ids is not None else "")

    return rows.withColumn(name, text(F.col(ids_col)))
