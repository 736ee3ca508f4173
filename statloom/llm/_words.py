"""Word and shingle hashes of whole texts, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
#: Powers of the base that are kept; longer texts compute theirs each time.
_KEPT = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of every element."""
    x = x + np.uint64((seed * _BASE + 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _KEPT), _powers(_BACK, _KEPT)
_BYTE = mix(np.arange(256, dtype=np.uint64), 3)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_UP, _DOWN) if n <= _KEPT else (_powers(_BASE, n), _powers(_BACK, n))


def raw(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text; ``lower`` changes A-Z only. Null: empty."""
    out = (text or "").encode("utf-8", "surrogatepass")
    return out.lower() if lower else out


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8. Null: none."""
    return raw(text, lower).split()


def hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    data = np.frombuffer(raw(text, lower), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _scale(n + 1)
    edge = np.diff(_SPACE[data], prepend=True, append=True)
    at = np.flatnonzero(edge)
    first, last = at[::2], at[1::2]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_BASE)
        out += h[i : i + n]
    return mix(out)


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` words by prefix sums, at a cost free of ``k``."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _scale(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(h, seed) * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1], seed + 1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct elements."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(1, dtype=bool), x[1:] != x[:-1]))] if len(x) else x


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of the lower-cased text.

    With fewer words the whole sequence is one shingle; without words: empty.
    """
    h = hashes(text, lower=True)
    if not len(h):
        return h
    if len(h) < k:
        return mix(grams(h, len(h)), len(h))
    return distinct(grams(h, k))
