"""Words and their hashes, straight from the buffers of an Arrow string column.

A batch is cut into runs of whole documents of about ``CHUNK`` bytes, so that the arrays of a run
stay small whatever the batch holds; one longer document is a run of its own. Words are identified
by 64-bit hashes: a polynomial over the bytes, taken from running sums, and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

# Separators by byte value.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; order matters."""
    return mix(left * _U(0xD6E8FEB86659FD93) + right + _U(0x2545F4914F6CDD1D))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, _BASE, _U)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _BASE_INVERSE
        _inverses = np.cumprod(steps)
    return _powers, _inverses


@dataclass
class Run:
    """Consecutive documents: row numbers [first, first + n) of the batch."""

    first: int
    n: int
    data: np.ndarray  # bytes of the documents, one after another
    bounds: np.ndarray  # n + 1 offsets into data

    def segments(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document (0 for the run's first) of the pieces between separators."""
        inside = ~separator[self.data]
        padded = np.empty(len(inside) + 1, bool)
        padded[0] = False
        padded[1:] = inside
        begins = inside & ~padded[:-1]
        cuts = self.bounds[1:-1]
        cuts = cuts[cuts < len(inside)]
        begins[cuts] = inside[cuts]  # a document's first byte starts a piece even without a separator
        starts = np.flatnonzero(begins)
        closes = np.zeros(len(inside) + 1, bool)
        closes[1:] = inside
        closes[:-1] &= ~inside | begins
        closes[0] = False
        ends = np.flatnonzero(closes)
        return starts, ends, self.documents(starts)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each piece's bytes."""
        powers, inverses = _grown(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE_VALUES[self.data] * powers[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U))

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Number of set bytes of each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def runs(texts: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[Run]:
    """Cut a string (or binary) array without nulls into runs of whole documents."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1]
    bounds = bounds.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + chunk, side="right")) - 1
        last = min(n, max(first + 1, last))
        part = whole[bounds[first] : bounds[last]]
        yield Run(first, last - first, LOWER[part] if lower else part, bounds[first : last + 1] - bounds[first])
        first = last


def counts_per(documents: np.ndarray, n: int) -> np.ndarray:
    """How many pieces each of n documents has."""
    return np.bincount(documents, minlength=n)
