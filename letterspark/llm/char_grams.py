"""Hashed character n-grams in numpy, for the language and toxicity models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint32(0x9E3779B1)
_NEXT = np.uint32(0x01000193)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-case text with each run of other characters as one space, in spaces; empty if no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.where(letters()[points], points, np.uint32(32))
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
    return x if len(x) > 1 else x[:0]


def buckets(x: np.ndarray, orders: tuple[int, ...], bits: int, starts: int | None = None) -> np.ndarray:
    """Buckets of all n-grams of ``x`` (of those at the first ``starts`` places) for the n in ``orders`` (ascending), one order after the other."""
    if not len(x):
        return np.empty(0, np.uint32)
    x = x.astype(np.uint32)
    out, h = [], x * _MIX + np.uint32(1)
    shift = np.uint32(32 - bits)
    for n in range(1, orders[-1] + 1):
        if n > 1:
            if len(h) < 2 or len(x) < n:
                break
            h = (h[:-1] * _NEXT ^ (h[:-1] >> np.uint32(15))) + x[n - 1 :] * _MIX
        if n in orders:
            g = h ^ (h >> np.uint32(16))
            out.append(((g * np.uint32(0x85EBCA6B) ^ (g >> np.uint32(13))) * _MIX >> shift)[:starts])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def bucket_parts(x: np.ndarray, orders: tuple[int, ...], bits: int, size: int) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of ``x`` in parts of ``size`` places; n-grams across the end of a part belong to it."""
    for a in range(0, len(x), size):
        yield buckets(x[a : a + size + orders[-1] - 1], orders, bits, size)
