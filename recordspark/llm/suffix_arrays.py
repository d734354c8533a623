"""Suffix arrays by induced sorting, with numpy taking whole stretches of the scan at a time.

Suffixes are classified as smaller or larger than their successors; the leftmost-smaller (LMS) substrings are sorted by
induction, named, and, where names repeat, the string of names is sorted the same way, recursively. Two linear scans
then induce the order of all suffixes. A scan copies a stretch at once as far as nothing that it places falls into the
stretch itself; from that place on it starts anew. So each stretch does just what the scan would do step by step.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is larger than the empty suffix."""
    n = len(s)
    out = np.zeros(n, bool)
    if n > 1:
        differ = np.flatnonzero(s[1:] != s[:-1])
        smaller = s[differ] < s[differ + 1]
        # equal neighbours are as the next one that differs; the tail of equal characters is larger
        at = np.searchsorted(differ, np.arange(n - 1))
        known = at < len(differ)
        out[:-1][known] = smaller[at[known]]
    return out


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def stable_order(c: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on, by 16-bit digits: linear (numpy sorts those by radix)."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(c.max()) if len(c) else 0, 16
    while top >> shift:
        order = order[np.argsort((c[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _ranks(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, where each character's group starts in it, each one's place in its group."""
    order = stable_order(chars.astype(np.int64)) if chars.dtype != np.uint16 else np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    sizes = np.diff(np.append(first, len(c)))
    return order, first, np.arange(len(c)) - np.repeat(first, sizes)


def induce(s: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the order `lms` of LMS suffixes induces. bounds: where each character's bucket starts, and the end."""
    n = len(s)
    out = np.full(n, -1, np.int64)
    if len(lms):
        order, first, rank = _ranks(s[lms])
        c = s[lms][order]
        sizes = np.diff(np.append(first, len(c)))
        out[bounds[c + 1] - np.repeat(sizes, sizes) + rank] = lms[order]
    heads = bounds[:-1].copy()
    out[heads[s[-1]]] = n - 1
    heads[s[-1]] += 1
    i, step = 0, 4096
    while i < n:
        j = min(n, i + step)
        at = np.flatnonzero(out[i:j] > 0)
        e = out[i + at] - 1
        larger = ~smaller[e]
        at, e = at[larger], e[larger]
        end = j
        if len(e):
            order, first, rank = _ranks(s[e])
            c = s[e][order]
            place = heads[c] + rank
            end = min(j, int(place[first].min()))
            done = at[order] < end - i
            out[place[done]] = e[order][done]
            heads[c[first]] += np.add.reduceat(done.astype(np.int64), first)
        step = max(1024, 2 * (end - i))
        i = end
    filled = out >= 0
    out[np.flatnonzero(filled)[smaller[out[filled]]]] = -1
    tails = bounds[1:].copy()
    j, step = n, 4096
    while j > 0:
        i = max(0, j - step)
        at = np.flatnonzero(out[i:j] > 0)[::-1]
        e = out[i + at] - 1
        own = smaller[e]
        at, e = at[own], e[own]
        end = i
        if len(e):
            order, first, rank = _ranks(s[e])
            c = s[e][order]
            place = tails[c] - 1 - rank
            end = max(i, int(place[first].max()) + 1)
            done = at[order] >= end - i
            out[place[done]] = e[order][done]
            tails[c[first]] -= np.add.reduceat(done.astype(np.int64), first)
        step = max(1024, 2 * (j - end))
        j = end
    return out


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The name of each LMS substring, in text order, and how many names there are; `ordered` has them sorted."""
    length = np.zeros(len(s), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, len(s) + 1)  # the last one's end is unlike any other
    n = length[ordered]
    same = np.concatenate([[False], n[1:] == n[:-1]]) & (ordered + n <= len(s))
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        equal = s[ordered[left] + k] == s[ordered[left - 1] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal & (n[left] > k)]
    rank = np.cumsum(~same) - 1
    at = np.zeros(len(s), np.int64)
    at[ordered] = rank
    return at[lms], int(rank[-1]) + 1


def suffix_array(s: np.ndarray, characters: int | None = None) -> np.ndarray:
    """The order of the suffixes of s, whose elements are 0, 1, ... characters - 1."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.asarray(s)
    characters = characters or int(s.max()) + 1
    if characters <= 1 << 16 and s.dtype != np.uint16:
        s = s.astype(np.uint16)  # numpy sorts these by radix
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=characters))])
    wide = s.astype(np.int64) if s.dtype == np.uint16 and characters == 1 << 16 else s
    smaller = classify(s)
    lms = leftmost_smaller(smaller)
    if len(lms) > 1:
        sorted_substrings = induce(wide, smaller, bounds, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        names, k = _names(s, lms, sorted_substrings[is_lms[sorted_substrings]])
        lms = lms[stable_order(names) if k == len(lms) else suffix_array(names, k)]
    return induce(wide, smaller, bounds, lms)


def permuted_common(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of s (bytes), in text order: how many elements its suffix shares with the one before it in order, `most` at most.

    Eight elements are compared at once, and only where all before them agreed; where they differ, the lowest bit that does tells the first element."""
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words |= padded[i : n + i] << np.uint64(8 * i)
    at = np.flatnonzero(before >= 0)
    room = np.minimum(most, n - np.maximum(at, before[at]))
    for k in range(0, most, 8):
        left = room > k
        at, room = at[left], room[left]
        if not len(at):
            break
        differ = words[at + k] ^ words[before[at] + k]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[at] = np.minimum(k + equal, room)
        at, room = at[differ == 0], room[differ == 0]
    return out
