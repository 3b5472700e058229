"""Vectorised helpers on Arrow string columns, for use inside Spark tasks.

A batch is cut into pieces of a few MB of text (one document at least), so the memory a
task needs follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U64), np.zeros(0, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n; kept and grown by each worker."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of the batch, its text bytes, offsets of its documents); null texts are empty."""
    text = batch.column(column).cast(pa.large_string())
    if text.null_count:
        text = pc.fill_null(text, "")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
        at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] times the inverse power i: a hash of bytes i to j, wherever they stand."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0][: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(((c[ends] - c[starts]) * powers(len(c))[1][starts]) + (ends - starts).astype(U64))


@dataclass
class Words:
    """Words of a piece: byte spans, the document of each, and where each document's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes that are not ASCII white space, within each document."""
    word = np.empty(len(data) + 1, bool)
    np.logical_not(IS_SPACE[data], out=word[:-1])
    word[-1] = False
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1]
    begins[at] |= word[at]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] |= word[last]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours; windows may cross documents, see inside()."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, U64)
    factor = 1
    for j in range(n):
        out += hashes[j : j + m] * U64(factor)
        factor = factor * _STEP & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that lie in one document."""
    m = max(0, len(doc) - n + 1)
    return np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values within each document's span."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def least_samples(x: np.ndarray, begin: np.ndarray, end: np.ndarray, factors: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """MinHash samples (len(factors), sets) of the 32-bit hashes x[begin:end] of each set; sets come in order, none is empty.

    Multiplying by an odd factor permutes the hashes. The sets are taken in blocks that stay in
    the processor's cache.
    """
    out = np.empty((len(factors), len(begin)), np.uint32)
    made = np.empty(block, np.uint32)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + block, "right")))
        own = x[begin[i] : end[j - 1]]
        made = made if len(made) >= len(own) else np.empty(len(own), np.uint32)
        # between two sets may lie hashes of neither
        at = np.stack([begin[i:j], end[i:j]], 1).ravel()[:-1] - begin[i]
        for k in range(len(factors)):
            out[k, i:j] = np.minimum.reduceat(np.multiply(own, factors[k], out=made[: len(own)]), at)[::2]
        i = j
    return out


def bands_of(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (bands, sets) of samples (bands * rows, sets), each sample salted with its number."""
    salted = mix(samples.astype(U64) + (np.arange(bands * rows, dtype=U64) << U64(32))[:, None])
    return mix(salted.reshape(bands, rows, samples.shape[1]).sum(1, dtype=U64) + np.arange(bands, dtype=U64)[:, None])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
