"""Suffix sorting by linear grouping.

Suffixes are grouped by their Lyndon prefix. Phase one starts from groups by first symbol and takes
groups in descending order: each member's previous suffix in a smaller group is found through
pointers that skip what is already done, and such suffixes go to a group of their own above their
former one, higher the more members they precede. Phase two emits the order: a suffix is its Lyndon
prefix followed by the next smaller suffix, so going through the sorted suffixes in ascending order
and putting those that end at the current one into their group's next place sorts every group.
Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in order, the empty suffix first. Symbols are positive integers."""
    n = len(s) + 1
    symbols = np.array([*s, 0], np.int64)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(first, n))
    starts = np.repeat(first, counts)
    at_start = np.zeros(n, np.int64)
    at_start[first] = counts
    places, groups = np.empty(n, np.int64), np.empty(n, np.int64)
    places[order], groups[order] = np.arange(n), starts
    sa, place, group, size = order.tolist(), places.tolist(), groups.tolist(), at_start.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        if end - start == 1:
            # A group of one: whatever precedes it goes to the top of its own group.
            i = sa[start]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    to = g + k - 1
                    at = place[p]
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    place[p], place[other] = to, at
                    group[p], size[to], size[g] = to, 1, k - 1
            end = start
            continue
        follows: dict[int, int] = {}
        for i in sorted(sa[start:end]):
            p = i - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            if p >= 0 and group[p] == start:
                p = before[p]
            before[i] = p
            if p >= 0:
                follows[p] = follows.get(p, 0) + 1
        if follows:
            by: dict[int, list[int]] = {}
            for p, k in follows.items():
                by.setdefault(k, []).append(p)
            for k in sorted(by, reverse=True):
                moved: dict[int, int] = {}
                for p in by[k]:
                    g = group[p]
                    m = moved[g] = moved.get(g, 0) + 1
                    to = g + size[g] - m
                    other, at = sa[to], place[p]
                    sa[to], sa[at] = p, other
                    place[p], place[other] = to, at
                for p in by[k]:
                    g = group[p]
                    m = moved[g]
                    if m < size[g]:
                        group[p] = g + size[g] - m
                for g, m in moved.items():
                    if m < size[g]:
                        size[g + size[g] - m] = m
                        size[g] -= m
        end = start
    out, following = [0] * n, list(range(n))
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[following[g]] = i
            following[g] += 1
            done[i] = 1
            i = before[i]
    return out
