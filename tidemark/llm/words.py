"""Words and n-gram hashes of Arrow text columns, computed for many texts at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points. All hashes are 64-bit: two given different words share
one with a probability of about 2**-61.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the hash base and of its inverse; those of the first ``KEPT`` positions stay."""

    KEPT = 1 << 20
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= cls.KEPT:
            return cls._made(n + 1)
        if len(cls.up) < cls.KEPT:
            cls.up, cls.down = cls._made(cls.KEPT)
        return cls.up, cls.down

    @staticmethod
    def _made(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        return tuple(out)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each text starts; the last entry is the end."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive runs of whole texts of about ``most`` bytes (one text may be longer): first row, bytes, starts."""
    body, at = raw(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, body[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` (one for each byte or word) over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Words:
    """The words of some texts: where they start and end, their text, their hash, each text's first word."""

    def __init__(self, body: np.ndarray, at: np.ndarray, lower: bool = False):
        self.body, self.at = LOWER[body] if lower else body, at
        inside = ~SPACE[self.body]
        first = np.zeros(len(body) + 1, bool)
        first[at] = True
        before = np.zeros(len(body), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros(len(body), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(at) - 1), self.n)
        self._total = None

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        if self._total is None:
            up, _ = _Powers.of(len(self.body))
            self._total = np.zeros(len(self.body) + 1, np.uint64)
            np.cumsum(_BYTE[self.body] * up[: len(self.body)], out=self._total[1:])
        _, down = _Powers.of(len(self.body))
        return mix((self._total[end] - self._total[start]) * down[start])

    @property
    def hash(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each of the places where n could start (also across texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(n))
