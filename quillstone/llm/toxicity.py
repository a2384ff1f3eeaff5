"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary training texts, one on toxic ones. A
text is cut into windows of some words; every window is compressed with the ordinary dictionary and with the toxic
one, and the difference of the two lengths, its gain, tells how much closer it is to toxic text. Compressing for
the toxic class, the toxic dictionary stands before the ordinary one: toxic text is ordinary but for a few
words, and a window without these has the same length in both runs instead of a random difference.

For the same reason the toxic dictionary is made of what toxic windows gain by. Each half of the toxic texts, in a few
splits, trains a dictionary for the other half; of a window of that half that gains more than hardly any ordinary window does, the word
without which it loses most of its gain is taken. Words that come from several toxic texts, and from far fewer ordinary
ones, are the dictionary. How many windows of a text reach each gain becomes a score through a logistic calibration on
training rows that the dictionaries have not seen, with the classes in their true proportion.
"""

from __future__ import annotations

import collections
import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import dataset_remainder, join_kind, map_arrow, stored

#: Labelled rows of each class that a model is fitted on at most, about.
FIT_ROWS = 2_500
#: Bytes of texts that a model is fitted on at most; rows beyond are left out by the hash of their ids.
FIT_BYTES = 64 << 20
ORDINARY_BYTES, TOXIC_BYTES = 64_000, 8_000
#: Lengths of the segments and of what they are compared by in training (the names of the library are k and d).
SEGMENT, UNIT = 64, 6
#: A window ends at the first blank after this many bytes.
WINDOW_BYTES = 40
#: Share of ordinary windows that may reach the gain from which a window of a toxic text counts.
ORDINARY_SHARE = 0.03
#: Toxic texts that a word of the toxic dictionary comes from at least, by number and by share, and how many times their share must be that of ordinary ones.
SUPPORT, SUPPORT_SHARE, RATIO = 2, 0.002, 4
#: Ways in which toxic texts are halved.
SPLITS = 3
#: Gains, in bytes, whose windows are counted.
GAINS = (1, 2, 3, 4, 6)
#: A level with lazy matching: the greedy ones choose worse matches in windows as short as these, at random.
LEVEL = 6
RIDGE = 1e-4
THRESHOLD = 0.3
BLANKED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case, ASCII signs blanked, one blank between words and at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(BLANKED).split()) + b" "


def windows(raw: bytes) -> np.ndarray:
    """(n, 2) begins and lengths; neighbours share the word at their border, with the blanks around it."""
    data = np.frombuffer(raw, "u1")
    blanks = np.flatnonzero(data == 32)
    if len(blanks) < 2:
        return np.zeros((0, 2), "i8")
    size = max(1, -(-len(raw) // WINDOW_BYTES))
    first = np.unique(np.searchsorted(blanks, np.arange(size) * WINDOW_BYTES).clip(0, len(blanks) - 2))
    last = np.minimum(np.r_[first[1:] + 1, len(blanks) - 1], len(blanks) - 1)
    return np.stack([blanks[first], blanks[last] - blanks[first] + 1], 1)


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; of few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=UNIT).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _cut(raw: bytes) -> list[bytes]:
    return [raw[a : a + n] for a, n in windows(raw).tolist()]


def _lengths(compressor: zstandard.ZstdCompressor, cuts: list[bytes]) -> np.ndarray:
    return np.fromiter((len(compressor.compress(x)) for x in cuts), "i8", len(cuts))


@dataclasses.dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """(texts, 1 + gains): the number of windows, and of those that reach each of GAINS."""
        if not hasattr(self, "_held"):
            self._held = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        out = np.zeros((len(raws), 1 + len(GAINS)))
        for i, raw in enumerate(raws):
            cuts = _cut(raw)
            if cuts:
                gain = _lengths(self._held[0], cuts) - _lengths(self._held[1], cuts)
                out[i] = len(cuts), *((gain >= g).sum() for g in GAINS)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def scores(self, raws: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(_inputs(self.counts(raws)) @ self.weights).clip(-30, 30)))


def _inputs(counts: np.ndarray) -> np.ndarray:
    n, reached = counts[:, :1], counts[:, 1:]
    share = reached / np.maximum(n, 1)
    return np.hstack([np.ones((len(n), 1)), np.log1p(n), np.sqrt(share), share, np.log1p(reached)])


def _calibrated(x: np.ndarray, y: np.ndarray, toxic_share: float) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge, the classes weighted to their true shares."""
    each = np.where(y > 0, toxic_share / max(1, (y > 0).sum()), (1 - toxic_share) / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        g = x.T @ (each * (p - y)) + RIDGE * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(h, g).clip(-2, 2)
    return w


def revealing(texts: list[bytes], alone: zstandard.ZstdCompressor, both: zstandard.ZstdCompressor, least: float) -> list[set[bytes]]:
    """For each text: of each window that gains least or more the word without which it loses most, if it loses anything, the first of equals."""
    gain = lambda w: len(alone.compress(w)) - len(both.compress(w))
    found = []
    for raw in texts:
        own = set()
        for window in _cut(raw):
            whole = gain(window)
            if whole < least:
                continue
            words = window.split()
            lost = [whole - gain(b" " + b" ".join(words[:k] + words[k + 1 :]) + b" ") for k in range(len(words))]
            if lost and max(lost) > 0:
                own.add(words[lost.index(max(lost))])
        found.append(own)
    return found


def fit(toxic: list[bytes], ordinary: list[bytes], toxic_share: float | None = None) -> ToxicityModel:
    """Dictionaries from two thirds of each class, calibration on the rest (on all, where there are few)."""
    parts = []
    for texts in (toxic, ordinary):
        few = len(texts) <= 30
        parts.append(([t for i, t in enumerate(texts) if few or i % 3], [t for i, t in enumerate(texts) if few or not i % 3]))
    (tox, rest_t), (plain, rest_p) = parts
    base = _trained([w for t in plain for w in _cut(t)], ORDINARY_BYTES)
    alone = _compressor(base)
    usual = [w for t in rest_p for w in _cut(t)]
    usual_length = _lengths(alone, usual)
    told: list[set[bytes]] = [set() for _ in tox]
    common: list[set[bytes]] = [set() for _ in rest_p[: len(tox)]]
    for split in range(SPLITS):
        half = [i >> split & 1 for i in range(len(tox))]
        for side in (0, 1):
            both = _compressor(_trained([w for t, h in zip(tox, half, strict=True) if h == side for w in _cut(t)], TOXIC_BYTES) + base)
            least = max(1.0, np.quantile(usual_length - _lengths(both, usual), 1 - ORDINARY_SHARE) + 0.5) if usual else 1.0
            asked = [i for i, h in enumerate(half) if h != side]
            for i, own in zip(asked, revealing([tox[i] for i in asked], alone, both, least), strict=True):
                told[i] |= own
            for i, own in enumerate(revealing(rest_p[: len(tox)], alone, both, least)):
                common[i] |= own
    toxic_texts, ordinary_texts = (collections.Counter(w for own in sets for w in own) for sets in (told, common))
    least, times = max(SUPPORT, SUPPORT_SHARE * len(tox)), RATIO * len(told) / max(1, len(common))
    kept = sorted((n, w) for w, n in toxic_texts.items() if n >= least and n > times * ordinary_texts[w])
    content = (b" " + b" ".join(w for _, w in kept) + b" ")[-TOXIC_BYTES:] if kept else _trained([w for t in tox for w in _cut(t)], TOXIC_BYTES)
    model = ToxicityModel(base, content, np.zeros(0))
    y = np.r_[np.ones(len(rest_t)), np.zeros(len(rest_p))]
    model.weights = _calibrated(_inputs(model.counts(rest_t + rest_p)), y, len(toxic) / (len(toxic) + len(ordinary)) if toxic_share is None else toxic_share)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> ToxicityModel | None:
    """Learns from labels.toxic of rows whose crc32(doc_id) mod 4 is not 2; None where a class is missing.

    Of each class about fit_rows rows are taken, by the hash of their ids, and of these the first by a hash that have up to fit_bytes together;
    null labels count as none. A doc_id with both labels teaches both.
    """
    known = labels.where((dataset_remainder("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, fit_rows / n[1])).otherwise(min(1.0, fit_rows / n[0]))
    drawn = stored(known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000), "drawn")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(drawn.hint(join_kind(drawn)), "doc_id")
    found: dict[int, list[bytes]] = {0: [], 1: []}
    size = 0
    for r in rows.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id", "toxic", "text").select("toxic", "text").toLocalIterator():
        raw = normal(r.text)
        size += len(raw)
        if size > fit_bytes:
            break
        found[r.toxic].append(raw)
    return fit(sorted(found[1]), sorted(found[0]), n[1] / (n[0] + n[1])) if found[0] and found[1] else None


def _score(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel | None = held.value
        for b in batches:
            raws = [normal(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(raws) if model else np.zeros(len(raws)))], ["doc_id", "score"])

    return score


def score(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """(doc_id, score) for every row, score from 0 to 1, higher for more toxic text; null counts as empty.

    Where nothing can be learnt all scores are 0. Repeated rows stay repeated; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))
    return map_arrow(docs.select("doc_id", "text"), _score(held), "doc_id long, score double")
