"""Hashed features of texts for the classifiers."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")
_SHAPES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+")


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    return _RUNS.sub(r"\1", word.translate(_SHAPES)) if len(word) <= 64 else "long"


def word_features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: 1 for each distinct lower-case word, and the share of words of each shape.

    A shape has A, a and 0 for letters and digits, and runs of one character
    count as one. Shares and the mean number of times a word occurs are set
    apart from the words by a mark before them.
    """
    split = (text or "").split()
    words = set(_WORD.findall((text or "").lower()))
    shapes = Counter(map(_shape, split))
    names = [w.encode() for w in words] + [b"\x01" + s.encode() for s in shapes] + [b"\x02"]
    shares = [n / len(split) for n in shapes.values()]
    repeats = len(split) / max(1, len(set(split)))
    values = [1.0] * len(words) + [4 * s for s in shares] + [min(4.0, repeats)]
    places = np.fromiter((zlib.crc32(x) % buckets for x in names), np.int64, len(names))
    return places, np.array(values)


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code points of letters, 32 for everything else, up to the end of the basic plane."""
    if not _TABLE:
        chars = map(chr, range(0x10000))
        _TABLE.append(np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in chars], np.uint32))
    return _TABLE[0]


def subword_buckets(text: str | None, buckets: int, lengths: tuple[int, ...] = (1, 2, 3, 4)) -> np.ndarray:
    """Bucket of every run of letters of the given lengths; a blank on either side may belong to it.

    None for a text without a letter.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    table = _letters()
    low = table[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF):
        low[k] = points[k] if chr(points[k]).isalpha() else 32
    if not np.any(low != 32):
        return np.zeros(0, np.int64)
    keep = np.r_[True, (low[1:] != 32) | (low[:-1] != 32)]
    chars = np.r_[np.uint32(32), low[keep], np.uint32(32)].astype(np.uint64)
    blank = chars == 32
    found = []
    for n in lengths:
        count = len(chars) - n + 1
        if count < 1:
            continue
        value = np.full(count, n, np.uint64)
        inner = np.zeros(count, bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                value = (value ^ chars[k : k + count]) * np.uint64(0x100000001B3)
                if n == 1 or 0 < k < n - 1:
                    inner |= blank[k : k + count]
            value = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        found.append((value % np.uint64(buckets)).astype(np.int64)[~inner])
    return np.concatenate(found) if found else np.zeros(0, np.int64)
