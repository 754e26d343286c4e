"""Words and word sequences of many texts at once, as NumPy columns; used inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, which is also what ``bytes.split()`` cuts. Words and word
sequences are named by 64-bit polynomial hashes modulo 2**64, taken as differences of running sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes, so that temporaries stay small.
SLICE = 2 << 20
#: Stands for a missing document id: no id is larger, so such a row owns nothing.
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_SYMBOL = np.random.default_rng(20250101).integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_LOWER_SYMBOL = _SYMBOL[_LOWER]
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "other": 0xA0761D6478BD642F}
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept between slices."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    out = values ^ (values >> np.uint64(33))
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair: sums of value times power, moved to the power of the start."""
    base = _BASE[kind]
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=running[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((running[ends] - running[starts]) * back[starts])


@dataclass
class Words:
    """Words of some texts. ``doc`` is each word's row, ``first`` the place of each row's first word (and the total)."""

    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def grams(self, k: int, kind: str = "word") -> np.ndarray:
        """Hash of the k words from each place on. A place less than k words before the end of all texts has none."""
        n = len(self.hashes) - k + 1
        places = np.arange(max(n, 0))
        return _ranges(self.hashes, places, places + k, kind)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each place of ``grams(k)`` on belong to one text."""
        n = max(len(self.hashes) - k + 1, 0)
        return self.doc[:n] == self.doc[k - 1: k - 1 + n]


def cut(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a binary Arrow array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset:].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0]: offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    hashes = _ranges((_LOWER_SYMBOL if lower else _SYMBOL)[data], starts, ends, "byte")
    return Words(hashes, doc, first, starts, ends, data)


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text or binary column as one binary array; null counts as empty."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.binary())
    return pc.fill_null(joined.cast(pa.binary()), b"")


def slices(batch: pa.RecordBatch | pa.Table, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch | pa.Table, pa.Array]]:
    """Runs of rows with about ``size`` bytes of ``text`` each, and their texts; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    texts = binary(batch.column("text"))
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        begun = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, begun + size, side="right")))
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


def ids(column) -> np.ndarray:
    """Document ids as 64-bit integers, ``NO_ID`` for null."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(joined.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def gathered(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after another."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return values[np.repeat(begin - (end - length), length) + np.arange(total)]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What was freed goes back to the system; a worker else waits for its next task with it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have:]) if width > have else out


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's ``bigint``."""
    return np.ascontiguousarray(values).view(np.int64)
