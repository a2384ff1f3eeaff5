"""Batches of texts as one array of bytes, for work on whole batches in numpy."""

from __future__ import annotations

import numpy as np

#: Texts are taken together up to about this many bytes.
BLOCK_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: list[bytes]):
    """(from, to) index ranges of texts with about BLOCK_BYTES together; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[bytes], mark: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text between marks, and where each text begins (at its mark); one more start at the end."""
    size = np.array([len(t) for t in texts], "i8") + 1
    return np.frombuffer(mark + mark.join(texts) + mark, "u1"), np.r_[0, np.cumsum(size)]


def gram_bins(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bin of the n-gram of bytes (n up to 8) that begins at each place."""
    m = max(0, len(codes) - n + 1)
    key = np.zeros(m, "u8")
    for k in range(n):
        key = key << np.uint64(8) | codes[k : k + m]
    return ((key + np.uint64(n)) * _ODD >> np.uint64(64 - bits)).astype("i4")


def own_grams(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text of joined() the range (from, to) of the n-grams that lie between its two marks, both included."""
    first = starts[:-1]
    return first, np.maximum(first, starts[1:] - n + 2)


def range_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges, 0 for empty ones; each depends on its own range only."""
    out = np.zeros(len(first))
    some = np.flatnonzero(last > first)
    if len(some):
        cuts = np.stack([first[some], last[some]], 1).ravel()
        padded = np.r_[values, 0]  # a range may end at the end
        out[some] = np.add.reduceat(padded, cuts, dtype="f8")[::2]
    return out
