"""Texts of an Arrow batch as flat numpy arrays: slices of bounded size, code points, words and their names.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. The
name of a word is a 64-bit hash of its bytes, the same in every task; two polynomial hashes over odd bases
are mixed, so that bytes of any length are covered without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

# Odd multipliers of the hash functions.
_BASE_A, _BASE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) with about ``most`` bytes of text and up to ``rows`` rows each; one row alone may be
    longer. Null is empty."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        stop = min(stop, start + rows)
        yield start, texts.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts one after another, and the offsets of the texts in them."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and the offsets of the texts in them."""
    data, _ = raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def sliced(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, so that the JVM holds few of its rows at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; idle workers then stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words(NamedTuple):
    """Words of several texts one after another; ``offsets`` has one entry per text and one more."""

    names: np.ndarray
    offsets: np.ndarray


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64; the usual slice size is kept."""
    kept = _powers.get(int(base))
    if kept is not None and len(kept[0]) >= size:
        return kept
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    wanted = max(size, SLICE_BYTES + 1024)
    table = []
    for b in (base, inverse):
        steps = np.full(wanted, b, dtype=np.uint64)
        steps[0] = 1
        table.append(np.multiply.accumulate(steps))
    if wanted <= 2 * SLICE_BYTES:
        _powers[int(base)] = (table[0], table[1])
    return table[0], table[1]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Names of all words; ``lower`` first lower-cases A-Z."""
    data, offsets = raw(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = solid[inner]  # a text begins a new word
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    ends[before] = solid[before]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = data.astype(np.uint64) + np.uint64(1)
    name = (last - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        for base in (_BASE_A, _BASE_B):
            up, down = _power_table(base, n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(value * up[:n], out=total[1:])
            name = mixed(name + (total[last] - total[first]) * down[first])
    return Words(name, np.searchsorted(first, offsets).astype(np.int64))
