"""Array kernels over whole Arrow batches of text, shared by the operators of this subpackage.

All functions work on a list of Python strings at a time and leave the loop over characters to
NumPy.  Hashes are polynomial hashes modulo 2^64 with an odd base, so that the hash of every
window follows from one running sum; callers finish them with ``mix``.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Characters handled in one go; longer texts make a block of their own.
BLOCK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for the code points of the Unicode categories L* and N*."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(_CODES)), np.bool_, _CODES)


@functools.lru_cache(maxsize=1)
def _code_values() -> np.ndarray:
    return mix(np.arange(1, _CODES + 1, dtype=np.uint64) * _BASE)


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, min(2 * BLOCK_CHARS, 2 * n))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        found = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p, dtype=np.uint64))
        _powers = (found[0], found[1])
    return _powers[0][:n], _powers[1][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def running(cp: np.ndarray) -> np.ndarray:
    """Running sums of the hash: the window [a, b) hashes to (s[b] - s[a]) * inverse_power[a]."""
    s = np.empty(len(cp) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_code_values()[cp] * powers(len(cp))[0], dtype=np.uint64, out=s[1:])
    return s


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """Slices [a, b) of the list with about ``limit`` characters each; a longer text stands alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line feed behind each, and the offset of each text (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return codes("\n".join(texts) + "\n" if texts else ""), at


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (maximal run of letters and numbers, lower-cased) and the words' offsets by text."""
    cp, at = join([t.lower() for t in texts])
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = word_table()[cp]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    s = running(cp)
    h = mix((s[end] - s[start]) * powers(len(cp) + 1)[1][start])
    return h, np.searchsorted(start, at)


def runs_of(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n consecutive words inside a text, and their offsets by text."""
    if len(h) < n:
        return h[:0], np.zeros_like(at)
    acc = mix(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        acc = mix(acc * _BASE + h[k : len(h) - n + 1 + k])
    count = np.maximum(np.diff(at) - (n - 1), 0)
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    first = np.repeat(at[:-1] - to[:-1], count)
    return acc[first + np.arange(to[-1])], to


def sliding(op: np.ufunc, v: np.ndarray, w: int) -> np.ndarray:
    """op over every window of w neighbours, by doubling; len(v) - w + 1 values."""
    done = 1
    while done * 2 <= w:
        v = op(v[:-done], v[done:])
        done *= 2
    return op(v[: len(v) - (w - done)], v[w - done :]) if w > done else v
