"""Suffix arrays by induced sorting, a bucket at a time.

The symbols are small numbers (bytes and separators), so a bucket holds many suffixes and every step of
the induction works on whole arrays: the suffixes that a bucket induces are appended, in order, to the
buckets of their first symbols. The time is linear in the text. Leftmost-smaller substrings are sorted by
the same induction; where they repeat, their names are a shorter text whose suffix array ranks them if they
are few enough for buckets; more names are ranked by doubling, which works on whole arrays at any number.
"""

from __future__ import annotations

import numpy as np

#: Names up to which a level of the recursion has a bucket for each; places between two whole comparisons.
BUCKETS, GAP = 512, 16


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; the last symbol is the unique smallest."""
    step = np.sign(np.diff(s.astype(np.int64)))
    n = len(step)
    later = np.where(step != 0, np.arange(n), n - 1)
    later = np.minimum.accumulate(later[::-1])[::-1]
    return np.append(step[later] > 0, True)


def _spread(j: np.ndarray, t: np.ndarray, lists: list[list[np.ndarray]], own: int) -> np.ndarray:
    """Appends ``j`` to the lists of their symbols ``t``, in order; gives those of the symbol ``own``."""
    order = np.argsort(t, kind="stable")
    j, t = j[order], t[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]])
    same = j[:0]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a < b:
            lists[t[a]].append(j[a:b])
            if t[a] == own:
                same = j[a:b]
    return same


def _induce(s: np.ndarray, small: np.ndarray, k: int, lms: list[np.ndarray]) -> np.ndarray:
    """The suffix array that is induced from ``lms``: by first symbol, the leftmost-smaller suffixes in order."""
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):
        done = 0
        while done < len(large[c]):
            wave, done = large[c][done], done + 1
            j = wave[wave > 0] - 1
            j = j[~small[j]]
            _spread(j, s[j], large, c)
        j = lms[c][lms[c] > 0] - 1
        _spread(j, s[j], large, c)
    whole = [np.concatenate([lms[c][:0], *large[c]]) for c in range(k)]
    lower: list[list[np.ndarray]] = [[] for _ in range(k)]
    lower[0].append(np.array([len(s) - 1]))
    for c in range(k - 1, -1, -1):
        done = 0
        while done < len(lower[c]):
            wave, done = lower[c][done], done + 1
            j = wave[wave > 0] - 1
            j = j[small[j]]
            _spread(j, s[j], lower, c)
        wave = whole[c][::-1]
        j = wave[wave > 0] - 1
        j = j[small[j]]
        _spread(j, s[j], lower, c)
    return np.concatenate([x for c in range(k) for x in (whole[c], np.concatenate([whole[c][:0], *lower[c]])[::-1])])


def _names(s: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings that begin at ``starts``, given their ``order``: equal for equal ones."""
    size = np.append(np.diff(starts), 0) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        x, y = a[active], b[active]
        differ = s[starts[x] + k] != s[starts[y] + k]
        same[active[differ]] = False
        active = active[~differ & (size[x] > k + 1)]
        k += 1
    names = np.empty(len(starts), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``names`` by doubling."""
    rank, n, k = names, len(names), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[False], np.diff(key[order]) != 0]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``names``: by their own suffix array if a level has a bucket for each name, else by doubling."""
    return suffix_array(names) if int(names.max()) < BUCKETS else _doubled(names)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``symbols`` (small numbers from 0) in lexical order; a suffix sorts before its extensions."""
    if not len(symbols):
        return np.empty(0, np.int64)
    s = np.append(symbols.astype(np.uint16) + 1, 0).astype(np.uint16)
    k = int(s.max()) + 1
    small = _types(s)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def by_symbol(lms: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(s[lms], kind="stable")
        return np.split(lms[order], np.cumsum(np.bincount(s[lms], minlength=k))[:-1])

    first = _induce(s, small, k, by_symbol(starts))
    number = np.full(len(s), -1)
    number[starts] = np.arange(len(starts))
    order = number[first]
    order = order[order >= 0]
    names = _names(s, starts, order)
    if names[order[-1]] != len(starts) - 1:
        order = _ranked(names)
    return _induce(s, small, k, by_symbol(starts[order]))[1:]


def common_prefixes(symbols: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: by place in the text, symbols that a suffix shares with the one before it in ``array``, up to ``most``; 0 for the first.

    One place in GAP is compared from its first symbol on. From one place to the next the number falls by one
    at most, so every other place begins where the last such one leaves it.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int32), np.full(most + GAP + 1, -1, np.int32)])
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]

    def compared(at: np.ndarray, shared: np.ndarray, cap: int) -> np.ndarray:
        active = np.flatnonzero(shared < cap)
        while len(active):
            i, k = at[active], shared[active]
            x = padded[i + k]
            active = active[(x == padded[before[i] + k]) & (x >= 0)]
            shared[active] += 1
            active = active[shared[active] < cap]
        return shared

    out, places = np.zeros(n, np.int64), np.arange(n)
    first = places[(places % GAP == 0) & (before >= 0)]
    out[first] = compared(first, np.zeros(len(first), np.int64), most + GAP)
    rest = places[(places % GAP > 0) & (before >= 0)]
    out[rest] = compared(rest, np.maximum(out[rest - rest % GAP] - rest % GAP, 0), most)
    return np.minimum(out, most)
