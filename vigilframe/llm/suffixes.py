"""Suffix order by the difference cover modulo 3, in numpy.

Suffixes that start at positions 1 and 2 modulo 3 are sorted by their triples; if triples repeat, the text of their
names is sorted by recursion. The remaining suffixes are sorted by their first letter and the rank of the next suffix.
Both orders are merged by rank: where a suffix of one order goes in the other follows from a binary search for its
first letter or two and a sampled rank.
"""

from __future__ import annotations

import numpy as np


def _names(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Ranks of the keys from 1 (equal keys share one), the number of ranks, and the order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.empty(len(keys), np.int64)
    new[order] = np.cumsum(np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64)))) if len(keys) else 0
    return new, int(new.max(initial=0)), order


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (integers from 1) in order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    top = int(t.max()) + 1
    # a suffix that starts at n pads the sample so that the last of those at 1 modulo 3 ends in a zero of its own
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate((ones, np.arange(2, n, 3)))
    if top < 1 << 20:
        names, count, order = _names((t[sample] * top + t[sample + 1]) * top + t[sample + 2])
    else:
        first, m, _ = _names(t[sample] * top + t[sample + 1])
        names, count, order = _names(first * top + t[sample + 2])
    if count < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    size = len(order) + 2
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] * size + rank[zero + 1], kind="stable")]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    kind1 = sampled % 3 == 1
    first, second = sampled[kind1], sampled[~kind1]
    one = lambda i: t[i] * size + rank[i + 1]
    pairs, _, _ = _names(np.concatenate((t[zero] * top + t[zero + 1], t[second] * top + t[second + 1]))) if len(zero) + len(second) else (np.empty(0, np.int64), 0, None)
    two_zero, two_second = pairs[: len(zero)] * size + rank[zero + 2], pairs[len(zero) :] * size + rank[second + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + np.searchsorted(one(first), one(zero)) + np.searchsorted(two_second, two_zero)] = zero
    before = np.empty(len(sampled), np.int64)
    before[kind1] = np.searchsorted(one(zero), one(first), side="right")
    before[~kind1] = np.searchsorted(two_zero, two_second, side="right")
    out[np.arange(len(sampled)) + before] = sampled
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts begin a string of `length` bytes that begins at another of them too.

    The starts are put in suffix order, where equal prefixes are neighbours, and neighbours' prefixes are compared.
    """
    out = np.zeros(len(text) + 1, bool)
    eligible = np.zeros(len(text) + 1, bool)
    eligible[starts] = True
    order = suffix_order(text.astype(np.int64) + 1)
    order = order[eligible[order]]
    if len(order) < 2:
        return out[starts]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for lo in range(0, len(order) - 1, 4096):
        part = order[lo : lo + 4097]
        # most neighbours differ early; only the others are compared in full
        a, b = part[:-1], part[1:]
        close = np.flatnonzero((windows[a, 0] == windows[b, 0]) & (windows[a, length // 2] == windows[b, length // 2]) & (windows[a, length - 1] == windows[b, length - 1]))
        same = close[(windows[a[close]] == windows[b[close]]).all(axis=1)]
        out[a[same]] = out[b[same]] = True
    return out[starts]
