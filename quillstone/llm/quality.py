"""Text quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the unlabelled set is the web text at large. A logistic
model on measures of a text is fitted by minimising the non-negative unbiased risk

    R = prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

No label of a bad text is used. The class prior comes from the texts as well: a logistic model that tells trusted
positives from unlabelled text estimates the ratio of their densities, which is 1 / prior wherever only good texts are;
as most positives lie there, the median ratio over the positives gives the prior.
"""

from __future__ import annotations

import dataclasses
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import dataset_remainder, map_arrow, stored

#: Rows of each kind (trusted positives, unlabelled) that a model is fitted on at most, about.
FIT_ROWS = 8_000
STEPS, RATE, DECAY = 800, 0.1, 1e-4
#: Least and largest prior, steps and ridge of the model that estimates it.
PRIORS, PRIOR_STEPS, RIDGE = (0.05, 0.99), 40, 1e-4
THRESHOLD = 0.3
SIGNS = b"!#$%&*|<>{}[]@^~_=+\\/"


def measures(text: str) -> list[float]:
    """Measures of one text, all finite; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    signs = kinds[list(SIGNS)]
    lines = text.split("\n")
    same = sum(map(operator.eq, words, words[1:]))
    tails = sum(1 for w in words if w[-1] in "!#$%&*|")
    packed = len(zlib.compress(raw, 1)) / size
    return [
        np.log1p(len(words)),
        np.log1p(len(raw) / n),
        len(set(words)) / n,
        len(set(words)) / n * min(1.0, n / 200),
        same / n,
        np.sqrt(same / n),
        upper / max(1, upper + lower),
        digits / size,
        signs.sum() / size,
        np.sqrt(signs.sum() / size),
        kinds[33] / size * 10,
        kinds[124] / size * 10,
        (kinds[35] + kinds[36] + kinds[37] + kinds[38] + kinds[42]) / size * 10,
        tails / n,
        np.sqrt(tails / n),
        kinds[46] / n,
        kinds[44] / n,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        min(packed, 1.5),
        min(packed, 1.5) * min(1.0, size / 2000),
        kinds[128:].sum() / size,
        float(not words),
    ]


@dataclasses.dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-6, 6)
        return np.hstack([z, z * z / 6, np.ones((len(z), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.inputs(x) @ self.weights).clip(-30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> QualityModel:
    """Full-batch Adam on the non-negative risk; where the unlabelled part turns negative, its gradient is reversed."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    m = QualityModel(mean, scale, np.zeros(2 * len(mean) + 1), prior)
    p, u = m.inputs(positive), m.inputs(unlabelled)
    w, a, b = m.weights, np.zeros_like(m.weights), np.zeros_like(m.weights)
    for step in range(1, STEPS + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        up = prior * (p.T @ (sp - 1)) / len(p)  # d prior * E_pos[log(1 + exp(-g))]
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = (up + down if rest >= 0 else -down) + DECAY * w
        a, b = 0.9 * a + 0.1 * grad, 0.999 * b + 0.001 * grad * grad
        w = w - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.weights = w
    return m


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([measures(t or "") for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["x"])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled: one over the median density ratio of the positives."""
    m = QualityModel(unlabelled.mean(0), unlabelled.std(0) + 1e-6, np.zeros(2 * unlabelled.shape[1] + 1), 0.5)
    p, u = m.inputs(positive), m.inputs(unlabelled)
    x, y = np.vstack([p, u]), np.r_[np.ones(len(p)), np.zeros(len(u))]
    each, w = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))], m.weights
    for _ in range(PRIOR_STEPS):  # Newton steps of a balanced logistic regression
        s = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w = w - np.linalg.solve((x * (each * s * (1 - s))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (each * (s - y)) + RIDGE * w)
    return float(np.clip(1 / np.median(np.exp((p @ w).clip(-30, 30))), *PRIORS))


def _measured(rows: DataFrame) -> np.ndarray:
    """Measures of the texts of a sample; few numbers a row come to the driver, no texts."""
    got = map_arrow(rows.select("text"), _measure, "x array<double>").toPandas()["x"]
    return np.array(got.tolist(), "f8").reshape(len(got), len(measures("")))


def _some(rows: DataFrame, n: int, total: int) -> DataFrame:
    """About n of total rows, by the hash of their ids."""
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * min(1.0, n / max(1, total)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Learns from rows with labels.quality = 1 whose crc32(doc_id) mod 5 is not 0, and from unlabelled text; None without such a row.

    About fit_rows of each are drawn by the hash of their ids before any text is read. Null labels and other labels count
    as none; a doc_id with several labels counts once.
    """
    good = stored(labels.where((dataset_remainder("doc_id", 5) != 0) & (F.col("quality") == 1)).select("doc_id").distinct(), "good")
    ids = _some(good, fit_rows, good.count())
    positive = _measured(docs.select("doc_id", "text").join(ids.hint("broadcast"), "doc_id", "left_semi"))  # about fit_rows ids
    unlabelled = docs.where(dataset_remainder("doc_id", 5) != 0).select("doc_id", "text")
    unlabelled = _measured(_some(unlabelled, fit_rows, docs.count()))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def _score(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([measures(t or "") for t in texts], "f8").reshape(len(texts), -1)
            s = model.scores(x) if model and len(texts) else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return score


def score(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """(doc_id, score) for every row, score from 0 to 1, higher for better text; null counts as empty.

    Where nothing can be learnt all scores are 0.5. Repeated rows stay repeated; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))
    return map_arrow(docs.select("doc_id", "text"), _score(held), "doc_id long, score double")
