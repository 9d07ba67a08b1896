"""Suffix arrays by induced sorting, and their common prefixes in text order, as numpy steps over whole stretches.

A suffix is of type S if it is smaller than the next one, else L; an S after an L is leftmost-smaller (LMS). LMS substrings
are sorted by one induction, named, and their names sorted by the same function (where most names are different, by
doubling); a second induction from their order gives the array. An induction scans the array by stretches whose slots are all filled, so that each step handles many suffixes.
"""

from __future__ import annotations

import numpy as np

STRETCH = 1 << 16


def _first(mask: np.ndarray) -> int:
    k = int(mask.argmax()) if len(mask) else 0
    return k if len(mask) and mask[k] else len(mask)


def _dealt(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by symbol, and the place of each of that order among its equals."""
    by = np.argsort(sym, kind="stable")
    s = sym[by]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return by, np.arange(len(s)) - np.repeat(head, np.diff(np.r_[head, len(s)]))


def _induced(text: np.ndarray, small: np.ndarray, bucket: np.ndarray, larges: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array of all suffixes, given the LMS ones in order (or in any order: then LMS substrings come out sorted).
    ``bucket``: first slot of each symbol and one more; ``larges``: how many L suffixes it has."""
    n = len(text)
    array = np.full(n, -1, np.int64)
    # LMS suffixes to the ends of their buckets, in their order.
    if len(lms):
        by, place = _dealt(text[lms])
        s = text[lms][by].astype(np.int64)
        count = np.bincount(s, minlength=len(larges))
        array[bucket[s + 1] - count[s] + place] = lms[by]
    # L suffixes from left to right. The last suffix is an L, and induced by the end.
    head = bucket[:-1].copy()
    is_large = np.zeros(n, bool)
    filled = larges > 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, bucket[:-1][filled], 1)
    np.add.at(edge, (bucket[:-1] + larges)[filled], -1)
    is_large[:] = np.cumsum(edge)[:-1] > 0
    array[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    at, step = 0, 256
    while at < n:
        part = array[at : at + step]
        ready = _first((part < 0) & is_large[at : at + step])
        p = part[:ready]
        p = p[p > 0] - 1
        p = p[~small[p]]
        if len(p):
            sym = text[p]
            by, place = _dealt(sym)
            p, sym = p[by], sym[by]
            array[head[sym] + place] = p
            head += np.bincount(sym, minlength=len(head)) if len(head) <= 1024 else 0
            if len(head) > 1024:
                np.add.at(head, sym, 1)
        at += ready
        step = min(STRETCH, 2 * step) if ready == len(part) else max(64, 2 * ready)
    # S suffixes from right to left, over the LMS ones.
    tail = bucket[1:].copy()
    array[~is_large] = -1
    at, step = n, 256
    while at > 0:
        lo = max(0, at - step)
        part = array[lo:at][::-1]
        ready = _first((part < 0) & ~is_large[lo:at][::-1])
        p = part[:ready]
        p = p[p > 0] - 1
        p = p[small[p]]
        if len(p):
            sym = text[p]
            by, place = _dealt(sym)
            p, sym = p[by], sym[by]
            array[tail[sym] - 1 - place] = p
            tail -= np.bincount(sym, minlength=len(tail)) if len(tail) <= 1024 else 0
            if len(tail) > 1024:
                np.subtract.at(tail, sym, 1)
        at -= ready
        step = min(STRETCH, 2 * step) if ready == len(part) else max(64, 2 * ready)
    return array


def _doubled(name: np.ndarray) -> np.ndarray:
    """The suffixes of ``name`` in order, where most names differ: ranks of pairs, of twice the length each time."""
    n, rank, k = len(name), name.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of ``text`` (numbers below ``symbols``) in order; the end is smaller than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # A suffix is S if the next differing symbol is larger; the last stretch of equal symbols is L.
    change = np.flatnonzero(text[1:] != text[:-1])
    small = np.zeros(n, bool)
    up = text[change + 1] > text[change]
    lengths = np.diff(np.r_[-1, change])
    small[: change[-1] + 1 if len(change) else 0] = np.repeat(up, lengths)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(text, minlength=symbols)
    bucket = np.r_[0, np.cumsum(count)]
    larges = np.bincount(text[~small], minlength=symbols)
    if len(lms) > 1:
        array = _induced(text, small, bucket, larges, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = array[is_lms[array]]
        # Names: equal LMS substrings, which end with the next LMS symbol, get equal ones; the last reaches the end.
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        a, b = order[:-1], order[1:]
        same = np.flatnonzero((length[a] == length[b]) & (length[a] > 0))
        k = 0
        differ = np.ones(len(a), bool)
        while len(same):
            x, y = a[same], b[same]
            ok = text[x + k] == text[y + k]
            same, over = same[ok], k + 1 >= length[x[ok]]
            differ[same[over]] = False
            same = same[~over]
            k += 1
        name = np.cumsum(np.r_[0, differ])
        if name[-1] + 1 == len(lms):
            lms = order
        else:
            named = np.empty(n, np.int64)
            named[order] = name
            names = int(name[-1]) + 1
            lms = lms[_doubled(named[lms]) if 2 * names > len(lms) else suffix_array(named[lms], names)]
    return _induced(text, small, bucket, larges, lms)


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the common prefix with the one before it in ``array``. Where both have the same
    symbol before them, it is that of the suffix one to the left, less one; only the others are compared."""
    n = len(text)
    ahead = np.full(n, -1, np.int64)
    ahead[array[1:]] = array[:-1]
    at = np.arange(n)
    apart = ahead <= 0
    apart[:1] = True
    apart[1:] |= text[:-1] != text[ahead[1:] - 1]
    got = np.zeros(n, np.int64)
    x = np.flatnonzero(apart & (ahead >= 0))
    y, k = ahead[x], 0
    while len(x):
        inside = np.maximum(x, y) + k < n
        got[x[~inside]] = k
        x, y = x[inside], y[inside]
        ok = text[x + k] == text[y + k]
        got[x[~ok]] = k
        x, y, k = x[ok], y[ok], k + 1
    last = np.maximum.accumulate(np.where(apart, at, 0))
    return got[last] - (at - last)
