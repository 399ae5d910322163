"""Words and their fingerprints from UTF-8 bytes, whole batches at a time, in numpy.

A word is a longest run of bytes of one class.  Its 64-bit fingerprint is a
polynomial in a random odd base over random byte values, finished by a mixing
step; equal words have equal fingerprints everywhere, and two different words
meet with a probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_draw = np.random.Generator(np.random.PCG64(0x5EED))
_VALUE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once.
STRETCH = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)


def _table(words: np.ndarray) -> np.ndarray:
    return np.where(words, _VALUE[_FOLD], np.uint64(0))


_BY_SPACE, _BY_ALNUM = _table(~_SPACES), _table(_ALNUM)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(raw: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``raw`` and the number of words before each row (one more than rows).

    ``alnum``: words are runs of letters, digits and all non-ASCII, else of all but white space.
    """
    inside = _ALNUM[raw] if alnum else ~_SPACES[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    edge = offsets[1:-1]
    before[edge[edge < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:] = inside
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    cut = np.zeros(len(raw) + 1, bool)
    cut[edge] = True
    ends = np.flatnonzero(stop & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(raw: np.ndarray, starts: np.ndarray, alnum: bool = False) -> np.ndarray:
    """64-bit fingerprints of the lower-cased (A-Z) words that spans() found; never 0."""
    global _up, _down
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _up, _down
    if len(raw) > len(up):
        size = 1 << int(len(raw) - 1).bit_length()
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if size <= 4 * STRETCH:
            _up, _down = up, down
    value = (_BY_ALNUM if alnum else _BY_SPACE)[raw]
    value *= up[: len(raw)]
    out = np.add.reduceat(value, starts)
    out *= down[starts]
    out = mix(out)
    out[out == 0] = 1
    return out


def prints(raw: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and the number of words before each row (one more than rows).

    Works through stretches that end between words, so that memory beside the result
    is bounded by STRETCH bytes of text, or by the longest word.
    """
    outside = ~_ALNUM if alnum else _SPACES
    parts, counts = [], [np.zeros(1, np.int64)]
    total, at, row = 0, 0, 0
    while row < len(offsets) - 1:
        # Whole rows as long as they fit, else a part of the next one.
        last = max(row, int(np.searchsorted(offsets, at + STRETCH, side="right")) - 1)
        to = int(offsets[last])
        if last == row:
            to = min(at + STRETCH, int(offsets[row + 1]))
            while to < offsets[row + 1]:
                found = np.flatnonzero(outside[raw[to : to + 4096]])
                if len(found):
                    to = min(to + int(found[0]), int(offsets[row + 1]))
                    break
                to += 4096
            to = min(to, int(offsets[row + 1]))
        inner = np.concatenate(([at], offsets[row + 1 : last], [to])) if last > row + 1 else np.array([at, to])
        starts, _, before = spans(raw[at:to], inner - at, alnum)
        parts.append(fingerprints(raw[at:to], starts, alnum))
        done = max(last, row + 1) if to == offsets[max(last, row + 1)] else row
        if done > row:
            counts.append(total + before[1:])
            row = done
        total += len(starts)
        at = to
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(counts)


def grams(prints: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k consecutive words that start at each word; the last k - 1 wrap and are not meaningful."""
    out = prints.copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + np.roll(prints, -i) + np.uint64(i))
    return out
