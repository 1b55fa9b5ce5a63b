"""Vectorised words, lines and n-grams over the bytes of Arrow string columns.

Texts stay UTF-8 bytes. A batch is cut into slices of whole documents, so memory is bounded by
``SLICE_BYTES`` or by the longest single document. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(6364136223846793005)  # odd, so that it has an inverse
_BACK = np.uint64(pow(6364136223846793005, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)


def byte_table(members: bytes | range, inverted: bool = False) -> np.ndarray:
    """True at the given byte values, or at all others."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return ~table if inverted else table


SPACED_WORD = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", inverted=True)
#: digits, a-z after lower-casing, and every byte of a non-ASCII character
ALNUM_WORD = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LINE = byte_table(b"\n", inverted=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, by in (("up", _STEP), ("down", _BACK)):
            table = np.full(size, by, np.uint64)
            table[0] = 1
            setattr(_Powers, name, np.multiply.accumulate(table))
    return _Powers.up[:n], _Powers.down[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of the texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cuts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document is a range of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


class Texts:
    """The texts of a slice of documents, with what is derived from them on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "replace")

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of marked bytes; a run never leaves its text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span, the same wherever the span lies."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:-1], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def of(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of each span, and the spans' bounds by text."""
        bounds = np.searchsorted(starts, self.offsets)
        return np.repeat(np.arange(self.n), np.diff(bounds)), bounds


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """Slices of a column of texts with the row each begins at."""
    data, offsets = flat(column)
    for a, b in cuts(offsets, most):
        part = data[offsets[a] : offsets[b]]
        yield a, Texts(LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a])
    pa.default_memory_pool().release_unused()  # a worker lives on after its batch


def grams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the word each begins at."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _STEP + words[k : k + m]
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(total[at]), at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs more than once, and whether it is one too many (all of a key but one)."""
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    later[order[1:][same]] = True
    every[order[1:][same]] = True
    every[order[:-1][same]] = True
    return every, later


def covered(at: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a run that begins at one of ``at``."""
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def with_owner(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(keys + owner.astype(np.uint64) * _MIX)


