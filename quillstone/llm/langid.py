"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the
languages with a one from those with a zero (log-odds weights with equal priors, averaged over the
n-grams of a text). A text goes to the language whose codeword is nearest in loss, each bit weighted by
how well its classifier separates training texts; a text whose two nearest codewords lie close together
is flagged as ambiguous.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textbytes
from quillstone.llm.common import dataset_remainder, map_arrow, stored

#: About so many labelled texts of each language are learnt from, by the hash of their ids.
ROWS_PER_LANGUAGE = 1500
GRAMS, BITS = (2, 3, 4), 15
#: Margins are multiplied by this before the loss, so that a clear text has a loss near zero.
SHARPNESS = 6.0
#: Shares of the two nearest languages closer than this: ambiguous.
AMBIGUOUS_GAP = 0.1
#: A text whose nearest codeword has more than this multiple of the loss of a text that tells nothing is in no learnt language:
#: its bits contradict every codeword, more clearly than those of a text in two languages do (1.6 at most were seen).
MOST_LOSS = 3.0
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all columns that tell languages apart for up to 7, else random ones of a fixed seed."""
    if n == 1:
        return np.ones((1, 1), "i1")
    if n <= 7:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(columns, "i1").T
    rng, width = np.random.default_rng(7), int(np.ceil(12 * np.log2(n)))
    while True:
        m = rng.choice(np.array([1, -1], "i1"), (n, width))
        if len(np.unique(m, axis=0)) == n and (np.abs(m.sum(0)) < n).all():
            return m


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: list[np.ndarray]  # one (bins, bits) for each n-gram size
    bit_weight: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """(texts, bits): the mean weight of a text's own n-grams, whatever texts stand beside it."""
        raw = [_letters(t) for t in texts]
        out = np.zeros((len(texts), self.codes.shape[1]))
        for a, b in textbytes.blocks(raw):
            codes, starts = textbytes.joined(raw[a:b], b" ")
            for n, w in zip(GRAMS, self.weights, strict=True):
                bins = textbytes.gram_bins(codes, n, BITS)
                first, last = textbytes.own_grams(starts, n)
                for j in range(w.shape[1]):
                    out[a:b, j] += textbytes.range_sums(w[:, j][bins], first, last) / np.maximum(last - first, 1)
        return (out / len(GRAMS)).astype("f4")

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share, its lead over the next, and its loss to that of a text without evidence."""
        z = SHARPNESS * margins[:, None, :] * self.codes[None]
        distance = (np.logaddexp(0, -z) * self.bit_weight).sum(2)
        share = np.exp((distance.min(1, keepdims=True) - distance) / 4)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        gap = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
        return distance.argmin(1), order[:, -1], gap, distance.min(1) / (np.log(2) * self.bit_weight.sum())


def _letters(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def gram_counts(texts: list[str]) -> np.ndarray:
    """(n-gram sizes, bins): how often each bin occurs in the texts."""
    out = np.zeros((len(GRAMS), 1 << BITS), "i8")
    raw = [_letters(t) for t in texts]
    for a, b in textbytes.blocks(raw):
        codes, starts = textbytes.joined(raw[a:b], b" ")
        for i, n in enumerate(GRAMS):
            bins = textbytes.gram_bins(codes, n, BITS)
            inside = np.zeros(len(bins) + 1, "i8")
            first, last = textbytes.own_grams(starts, n)
            np.add.at(inside, np.minimum(first, len(bins)), 1)
            np.add.at(inside, np.minimum(last, len(bins)), -1)
            out[i] += np.bincount(bins[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS)
    return out


def from_counts(names: list[str], counts: np.ndarray) -> LanguageModel:
    """A model with equal bit weights from counts (languages, n-gram sizes, bins)."""
    codes, weights = codewords(len(names)), []
    for i in range(len(GRAMS)):
        c = counts[:, i].astype("f8")
        p = (c + 0.5) / (c + 0.5).sum(1, keepdims=True)
        w = np.zeros((1 << BITS, codes.shape[1]), "f4")
        for j in range(codes.shape[1]):
            one, zero = codes[:, j] > 0, codes[:, j] < 0
            if zero.any():
                w[:, j] = np.log(p[one].mean(0)) - np.log(p[zero].mean(0))
        weights.append(w)
    return LanguageModel(names, codes, weights, np.ones(codes.shape[1]))


def weigh_bits(model: LanguageModel, right: np.ndarray) -> LanguageModel:
    """Bit weights from the share of training texts that each bit is right for."""
    odds = np.log(right.clip(0.5, 0.999) / (1 - right.clip(0.5, 0.999))).clip(0.05)
    model.bit_weight = odds / odds.sum() * len(odds)
    return model


def bits_right(model: LanguageModel, texts: list[str], langs: list[str]) -> np.ndarray:
    """For each bit the number of texts whose margin has the sign of their language."""
    which = {k: i for i, k in enumerate(model.languages)}
    return (np.sign(model.margins(texts)) == model.codes[[which[k] for k in langs]]).sum(0)


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """Learns from text and non-null lang of rows whose crc32(doc_id) mod 5 is not 0; None where there are none.

    Of each language about rows_per_language texts are taken, those with the smallest hashes of doc_id. They stay in
    the executors: n-grams are counted there, and only bins x languages counts come to the driver.
    """
    known = docs.where((dataset_remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    which = {k: i for i, k in enumerate(names)}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])
    drawn = stored(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang"), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[str]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(k, []).append(t)
            for k, some in texts.items():
                flat = gram_counts(some).ravel()
                used = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), which[k], "i4")), pa.array(used.astype("i4")), pa.array(flat[used])], ["language", "place", "n"])

    counts = np.zeros((len(names), len(GRAMS) << BITS), "i8")
    for r in map_arrow(drawn, count, "language int, place int, n long").groupBy("language", "place").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.language, r.place] = r.n
    model = from_counts(names, counts.reshape(len(names), len(GRAMS), -1))
    if len(names) == 1:
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                right = bits_right(held.value, b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right), dtype="i4")), pa.array(right.astype("i8")), pa.array(np.full(len(right), b.num_rows, "i8"))], ["bit", "right", "n"])

    told = map_arrow(drawn, judge, "bit int, right long, n long").groupBy("bit").agg((F.sum("right") / F.sum("n")).alias("share")).collect()
    shares = np.zeros(model.codes.shape[1])
    for r in told:
        shares[r.bit] = r.share
    return weigh_bits(model, shares)


def _predict(held):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel | None = held.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            if model:
                best, share, gap, loss = model.decode(model.margins(texts))
                names = [model.languages[i] for i in best]
            else:
                names, share, gap, loss = [UNKNOWN] * len(texts), *np.zeros((3, len(texts)))
            letter = np.array([_has_letter(t) for t in texts], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k if ok else UNKNOWN for k, ok in zip(names, letter, strict=True)]), pa.array(np.where(letter, share, 0.0).astype("f8")), pa.array((gap < AMBIGUOUS_GAP) & letter), pa.array(loss.astype("f8"))],
                ["doc_id", "lang_pred", "score", "ambiguous", "loss"],
            )

    return predict


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous, loss) for every row; without a model one is learnt from docs.

    loss is that of the nearest codeword, as a multiple of the loss of a text that tells nothing.
    Null texts and texts without a letter are ``und`` with score 0 and not ambiguous, and so is everything
    where nothing could be learnt. Equal shares go to the first language in order. Repeated rows stay
    repeated and other columns are not read.
    """
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bins x bits x n-gram sizes, whatever the input
    return map_arrow(docs.select("doc_id", "text"), _predict(held), "doc_id long, lang_pred string, score double, ambiguous boolean, loss double")


def with_language(docs: DataFrame) -> DataFrame:
    """docs without the rows that have no language; columns as they were.

    Rejected are null and letterless texts, and texts whose bits contradict every codeword (loss above MOST_LOSS). An
    ambiguous text, as one in two languages, is kept, and so is every text with a letter where no model could be learnt.
    """
    model = train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, learnt = docs.columns.index("text"), model is not None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(held)
        for b in batches:
            if not learnt:
                yield b.filter(pa.array([_has_letter(t or "") for t in b.column(at).to_pylist()], pa.bool_()))
                continue
            ids = pa.array(range(b.num_rows), pa.int64())
            (seen,) = predict([pa.RecordBatch.from_arrays([ids, b.column(at)], ["doc_id", "text"])])
            known = pa.compute.not_equal(seen.column("lang_pred"), UNKNOWN)
            yield b.filter(pa.compute.and_(known, pa.compute.less_equal(seen.column("loss"), MOST_LOSS)))

    return map_arrow(docs, keep, docs.schema)
