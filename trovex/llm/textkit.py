"""Vectorised text primitives on Arrow string columns: words, lines and 64-bit word hashes for a whole batch at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals the same run of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown when needed and kept by the worker."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        m = 1 << max(16, (n - 1).bit_length())
        have = np.empty(m, np.uint64)
        have[0] = 1
        done = 1
        while done < m:
            step = np.uint64(pow(base, done, 2**64))
            take = min(done, m - done)
            have[done : done + take] = have[:take] * step
            done += take
        _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most_bytes`` together, one row at least."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of many texts. ``first[d] .. first[d+1]`` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (the first ``most``, if given)."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_P, n), out=acc[1:])
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mix((acc[end] - acc[self.start]) * _power(_P_INV, n)[self.start])


def words(col: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffer(col)
    if lower:
        data = lower_ascii(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    if len(inner):
        begins[inner] = solid[inner]
        stops[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]]."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def per_doc_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest of values[first[d]:first[d+1]], 0 without any."""
    out = np.zeros(len(first) - 1, values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(values, first[some])
    return out
