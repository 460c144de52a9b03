"""Vectorised text kernels that run inside Spark tasks: word spans, word hashes, n-gram hashes, sampled anchors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20

#: ASCII white space: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters and digits: all ASCII but 0-9 and a-z (of text that is in lower case already).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not (chr(i).isdigit() or "a" <= chr(i) <= "z") for i in range(128)]
#: A-Z to a-z, for bytes.translate.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def chain(x: int) -> np.ndarray:
        a = np.full(n, x, np.uint64)
        a[0] = 1
        return np.cumprod(a, dtype=np.uint64)

    return chain(_BASE), chain(_BASE_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    return _powers(1 << max(16, int(n - 1).bit_length()) if n > 1 else 1 << 16)


def word_spans(a: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes that are no separators."""
    if not a.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(a.size + 2, np.int8)
    inside[1:-1] = ~separators[a]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(starts.size, np.uint64)
    i = 0
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        pw, inv = powers(hi - lo + 1)
        c = np.empty(hi - lo + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTES[a[lo:hi]] * pw[: hi - lo], dtype=np.uint64, out=c[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Spans:
    """Hashes of any spans of one array of bytes (kept to about a megabyte by the caller), the same as those of span_hashes."""

    def __init__(self, a: np.ndarray) -> None:
        pw, self.inverse = powers(a.size + 1)
        self.sums = np.empty(a.size + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTES[a] * pw[: a.size], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    if h.size < n:
        return np.empty(0, np.uint64)
    m = h.size - n + 1
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * _GRAM + h[j : j + m]
    return mix(g)


def byte_grams(a: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive bytes, by a rolling polynomial."""
    m = a.size - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(m, np.uint64)
    pw, inv = powers(min(m, _PIECE) + n)
    for lo in range(0, m, _PIECE):
        k = min(_PIECE, m - lo)
        c = np.empty(k + n, np.uint64)
        c[0] = 0
        np.cumsum(_BYTES[a[lo : lo + k + n - 1]] * pw[: k + n - 1], dtype=np.uint64, out=c[1:])
        out[lo : lo + k] = (c[n:] - c[:k]) * inv[:k]
    return mix(out)


def window_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width consecutive values, the index of its smallest (by the high 32 bits), the leftmost if several."""
    m = g.size - width + 1
    if m <= 0:
        return np.empty(0, np.int64)
    out = np.empty(m, np.int64)
    for lo in range(0, m, _PIECE):
        k = min(_PIECE, m - lo)
        n = k + width - 1
        key = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        key[:n] = (g[lo : lo + n] & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        rows = key.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        best = np.minimum(back[:k], ahead[width - 1 : width - 1 + k])
        out[lo : lo + k] = (best & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if h.size else h


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return h.view(np.int64)


def as_bytes(column) -> list:  # noqa: ANN001
    """Values of an Arrow string column as bytes or None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
