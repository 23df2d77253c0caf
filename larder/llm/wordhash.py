"""Vectorised word and word-window fingerprints over UTF-8 text, in numpy.

Words are maximal runs of bytes other than the six ASCII white-space characters. A word's fingerprint is a polynomial over
random 64-bit byte values modulo 2**64, obtained for all words at once from one running sum, then mixed; a window's
fingerprint combines the fingerprints of its words in order the same way. Equal sequences always agree and different
ones differ but for 64-bit chance, whatever process or machine computes them.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WINDOW_MULTIPLIER = 0xD6E8FEB86659FD93
_WINDOW_INVERSE = pow(_WINDOW_MULTIPLIER, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_PIECE = 1 << 21  # bytes hashed at once


class _Powers(dict):
    """Powers by base, made as they are needed; shipped to workers empty."""

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or have.size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words of ``raw``."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each word ``raw[starts[i]:ends[i]]``; long texts are taken in pieces that end with a word."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    if len(raw) > _PIECE and starts.size > 1:
        out, k = [], 0
        while k < starts.size:
            last = max(k + 1, int(np.searchsorted(ends, starts[k] + _PIECE, side="right")))
            a, b = int(starts[k]), int(ends[last - 1])
            out.append(_piece_hashes(raw[a:b], starts[k:last] - a, ends[k:last] - a))
            k = last
        return np.concatenate(out)
    return _piece_hashes(raw, starts, ends)


def _piece_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    terms = _BYTE_VALUES[np.frombuffer(raw, np.uint8)] * _powers(_MULTIPLIER, len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every run of ``width`` consecutive words, by start position; empty if there are fewer words."""
    n = words.size
    if n < width or width < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_WINDOW_MULTIPLIER, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _powers(_WINDOW_INVERSE, n)[: n - width + 1] + np.uint64(width))


def text_words(raw: bytes) -> np.ndarray:
    """Word fingerprints of a text, in order."""
    return word_hashes(raw, *word_spans(raw))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of the ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    words = text_words(raw)
    if not words.size:
        return words
    return np.unique(window_hashes(words, min(width, words.size)))


def repeated_window_words(words: np.ndarray, width: int) -> int:
    """How many words lie in a ``width``-word window that occurs twice or more in the same text."""
    windows = window_hashes(words, width)
    if windows.size < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(windows.size, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return int(covered(np.flatnonzero(again), width, words.size).sum())


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask over ``n`` words: those in one of the windows ``[start, start + width)``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0
