"""Enhanced suffix arrays of the words of some texts, in numpy.

Suffixes are sorted by doubling: after k steps, ``levels[k]`` numbers the groups
of positions that begin with the same 2**k words. Only positions that still
share their group are sorted again, so words that are rare cost one sort. The
levels stay: they give common prefixes and common suffixes of any two positions
by as many comparisons as there are levels. Texts never meet: a position's first
number holds its text, so groups, intervals and prefixes lie within one text.
"""

from dataclasses import dataclass

import numpy as np


@dataclass
class Suffixes:
    """``order`` lists the positions as their suffixes are sorted, ``place`` is
    its inverse, ``lcp[b]`` the words that the suffixes at b - 1 and b share.
    Position i lies in the text begin[i] .. end[i]."""

    levels: list[np.ndarray]
    order: np.ndarray
    place: np.ndarray
    lcp: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _common_prefix(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the suffixes at x and y (different, of one text) share."""
    length = np.zeros(len(x), dtype=np.int64)
    for k in reversed(range(len(levels) - 1)):
        length += (levels[k][x + length] == levels[k][y + length]).astype(np.int64) << k
    return length


def build(code: np.ndarray, first: np.ndarray) -> Suffixes:
    """The array over the codes of words, those of text i at first[i] .. first[i + 1]."""
    n = len(code)
    size = np.diff(first)
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    owner = np.repeat(np.arange(len(size)), size)
    key = owner * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    group = np.empty(n + 1, dtype=np.int64)
    group[n] = -1  # beyond the last text: equal to no position

    def number(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number the groups of order[at], sorted by ``key``; the places that
        share their group are returned."""
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = np.diff(key) != 0
        heads = np.flatnonzero(fresh)
        count = np.diff(np.append(heads, len(at)))
        group[order[at]] = np.repeat(at[heads], count)
        return at[np.repeat(count > 1, count)]

    shared = number(np.arange(n), key[order])
    levels = [group.copy()]
    step = 1
    while len(shared):
        s = order[shared]
        further = np.where(s + step < end[s], group[np.minimum(s + step, n)] + 1, 0)
        key = group[s] * (n + 1) + further
        by = np.argsort(key, kind="stable")
        order[shared] = s[by]
        shared = number(shared, key[by])
        levels.append(group.copy())
        step *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n + 1, dtype=np.int64)
    b = 1 + np.flatnonzero(np.diff(levels[0][order]) == 0)
    lcp[b] = _common_prefix(levels, order[b - 1], order[b])
    return Suffixes(levels, order, place, lcp, begin, end)


def _parts(lcp: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary b of the sorted suffixes, (low, high): the interval of
    suffixes low .. high - 1 that share lcp[b] words and that b is the last
    boundary to part, into low .. b - 1 and b .. high - 1."""
    least, depth = [lcp], lcp[b]
    while (least[-1] > 0).any():
        step = 1 << (len(least) - 1)
        wider = np.zeros_like(lcp)
        wider[:-step] = np.minimum(least[-1][:-step], least[-1][step:])
        least.append(wider)
    low, high = b.copy(), b + 1
    for k in reversed(range(len(least))):
        to = low - (1 << k)
        low = np.where((to >= 0) & (least[k][np.maximum(to, 0)] >= depth), to, low)
        # a block that reaches beyond the end counts as zero
        wide = least[k][np.minimum(high, len(lcp) - 1)] > depth
        high = np.where(wide, high + (1 << k), high)
    return low - 1, high


#: Suffixes whose partners are looked up at a time.
_AT_ONCE = 1 << 20


def branching_squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, depth) of every square of two equal halves of ``depth`` words
    that is not followed by the word its second half begins with.

    For each common-prefix interval of a depth, and each suffix i of the smaller
    of its two parts, i + depth and i - depth are looked up in the inverse
    array: if one lies in the other part, it shares exactly ``depth`` words with
    i. Every suffix is in the smaller part as often as the logarithm of the
    length at most."""
    b = np.flatnonzero(s.lcp > 0)
    low, high = _parts(s.lcp, b)
    left = b - low <= high - b
    at, size = np.where(left, low, b), np.where(left, b - low, high - b)
    begin, until = np.where(left, b, low), np.where(left, high, b)  # the other part
    total, n = np.cumsum(size), len(s.order)
    starts, depths = [], []
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + _AT_ONCE, side="right")))
        own = np.repeat(np.arange(i, j), size[i:j])
        suffix = s.order[np.arange(len(own)) + np.repeat(at[i:j] - (total[i:j] - size[i:j]) + (total[i] - size[i]), size[i:j])]
        depth = s.lcp[b[own]]
        for other, good in ((suffix + depth, suffix + depth < s.end[suffix]), (suffix - depth, suffix - depth >= s.begin[suffix])):
            place = s.place[np.clip(other, 0, n - 1)]
            good &= (place >= begin[own]) & (place < until[own])
            starts.append(np.minimum(suffix, other)[good])
            depths.append(depth[good])
        i = j
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(depths)


def rotated(s: Suffixes, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the leftmost square is that each square rotates to, one word at a
    time: by as many words as stand alike before both of its halves."""
    at = start.copy()
    for k in reversed(range(len(s.levels) - 1)):
        to = at - (1 << k)
        inside = np.maximum(to, 0)
        alike = (to >= s.begin[start]) & (s.levels[k][inside] == s.levels[k][inside + depth])
        at = np.where(alike, to, at)
    return at
