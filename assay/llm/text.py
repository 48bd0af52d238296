"""Vectorised text kernels: words, n-grams and their hashes over Arrow string buffers.

All kernels work on the UTF-8 bytes of whole texts. Hashes are polynomial,
modulo 2**64, over a random 64-bit value per byte, read off prefix sums; the
same bytes give the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of BYTE[v] * BASE**i, with a leading 0."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(BYTE[values] * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), read off :func:`prefix`."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


class Words:
    """Words of a range of texts: byte spans, hashes and the row each is in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, word: np.ndarray):
        lo, hi = int(offsets[i]), int(offsets[j])
        low = LOWER[raw[lo:hi]]
        inside = word[low]
        self.bytes, self.rows = low, j - i
        bounds = offsets[i : j + 1] - lo
        before = np.empty(len(low) + 1, dtype=bool)
        before[0], before[-1] = False, False
        before[1:] = inside
        first = np.zeros(len(low) + 1, dtype=bool)
        first[bounds] = True
        padded = np.append(inside, False)
        self.start = np.flatnonzero(padded & (~before | first))
        self.end = np.flatnonzero(before & (~padded | first))
        self.sums = prefix(low)
        self.hash = mixed(spans(self.sums, self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.at = np.searchsorted(self.start, bounds)  # of row k: words at[k]..at[k+1]
        self.count = np.diff(self.at)
        self.row = np.repeat(np.arange(self.rows), self.count)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``k`` words; a shorter, not empty text is one run."""
    n = len(words.hash)
    m = max(0, n - k + 1)
    out = np.zeros(m, dtype=np.uint64)
    for d in range(k):
        out += words.hash[d : d + m] * MIX[d]
    rows = words.row[: len(out)]
    whole = rows == words.row[k - 1 :] if len(out) else np.zeros(0, bool)
    rows, out = rows[whole], mixed(out[whole] + np.uint64(k))
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = np.array([mixed(np.array([np.sum(words.hash[a : a + c] * MIX[:c], dtype=np.uint64) + np.uint64(c)]))[0] for a, c in zip(words.at[short], words.count[short], strict=True)], dtype=np.uint64)
        rows, out = np.concatenate([rows, short]), np.concatenate([out, extra])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out
