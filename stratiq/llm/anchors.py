"""Content-chosen anchors: every ``window``-byte string names one of its ``gram``-byte substrings by its bytes alone.

Equal windows thus share their anchor, and the windows with one anchor in a
text are neighbours: a segment.  Numpy helpers on one text at a time.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a piece of text, so that places fit the low bits of a key.
PIECE = 1 << 23
PLACE_BITS = np.uint64(24)
PLACE = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


VALUES = _values(5)
UP, DOWN = _powers(BASE, 1), _powers(INVERSE, 1)


def _grown(n: int) -> None:
    global UP, DOWN
    if len(UP) < n:
        UP, DOWN = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Prefix sums of a polynomial over the bytes: the hash of any range in a few operations."""

    def __init__(self, text: np.ndarray):
        _grown(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(VALUES[text] * UP[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * DOWN[start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(text: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sums]:
    """Segments of texts laid end to end: first window, last window, anchor hash; and the sums.

    ``owner`` numbers the text of each byte; no window crosses texts.
    """
    sums = Sums(text)
    n = len(text) - gram + 1
    grams = (sums.sums[gram:] - sums.sums[:-gram]) * DOWN[:n]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    keys = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
    least = _least(keys, window - gram + 1)
    start = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
    anchor = (least[start] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else anchor
    return start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else new, mixed(grams[anchor[new]]), sums


def pieces(n: int, window: int) -> list[tuple[int, int]]:
    """Ranges of a text of n bytes that are looked at alone; each window lies in exactly one as a start."""
    step = PIECE - window + 1
    return [(a, min(n, a + PIECE)) for a in range(0, max(1, n - window + 1), step)] if n >= window else []
