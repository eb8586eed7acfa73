"""Words, shingles and their 64-bit hashes, computed on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone. Temporary arrays take about 40 times that.
CHUNK = 1 << 20

U = np.uint64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    def __init__(self, base: int):
        self.base, self.inv = base, _inverse(base)
        self.p = self.q = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            n = max(n, 2 * len(self.p), CHUNK + 1024)
            with np.errstate(over="ignore"):
                self.p = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.base, U)]), dtype=U)
                self.q = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.inv, U)]), dtype=U)
        return self.p, self.q


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def texts(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of groups of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, "right")) - 1)
        j = min(j, len(column))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_table() -> np.ndarray:
    """Bytes of words (0-9, a-z, and all above 0x7F), A-Z to a-z; 0 for what stands between words."""
    t = np.arange(256, dtype=np.uint8)
    t[:0x30] = 0
    t[0x3A:0x41] = 0
    t[0x41:0x5B] += 32
    t[0x5B:0x61] = 0
    t[0x7B:0x80] = 0
    return t


def segments(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a text's end, and where each text's runs begin."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] (small non-zero values), whatever their place."""
    p, q = _BYTES.get(len(values) + 1)
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U, copy=False) * p[: len(values)], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts])


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each text and the total)."""
    t = table[buf]
    starts, ends, at = segments(t != 0, offs)
    return span_hashes(t, starts, ends), starts, ends, at


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of width consecutive words, first of each text); a text of fewer words, but not none, has one."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    starts = np.repeat(at[:-1] - first[:-1], count) + np.arange(total)
    ends = np.minimum(starts + width, np.repeat(at[1:], count))
    p, q = _WORDS.get(len(h) + 1)
    c = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U)), first
