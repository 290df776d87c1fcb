"""Suffix arrays by linear grouping construction, for many short texts at once.

The construction sorts suffixes in two phases. First, groups of suffixes (at the start, by first symbol) are processed in
descending order: each member points to the nearest earlier suffix of a smaller group, and suffixes that are pointed to
move, within their group, behind those that are not, by how often; in the end a group shares its longest Lyndon prefix.
Then the groups' order is emitted from the smallest suffix upward: whatever precedes a suffix, along its pointers, comes
next in its own group. There is no renaming and no recursion. Here a step handles one group of every row of a matrix, so
that its cost is spread over many texts.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(t: np.ndarray) -> np.ndarray:
    """t: rows of symbols, 0 for separators and padding, at least one 0 at each row's end. Returns each row's suffixes in order.

    Suffixes that are equal up to a separator come in some fixed order of their separators.
    """
    rows, m = t.shape
    wide = np.arange(rows)[:, None]
    # groups by first symbol; a group is named by its first place in the row's order
    order = np.argsort(t, axis=1, kind="stable")
    sorted_ = np.take_along_axis(t, order, 1)
    new = np.ones((rows, m), dtype=bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(m), 0), axis=1).astype(np.int32)
    group = np.empty((rows, m), dtype=np.int32)
    group[wide, order] = start
    size = np.zeros((rows, m), dtype=np.int32)
    np.add.at(size, (np.broadcast_to(wide, start.shape), start), 1)
    prev = np.full((rows, m), -1, dtype=np.int32)
    # suffixes by group, and each one's place among them: a group is a range of places
    member = order.astype(np.int32)
    seat = np.empty((rows, m), dtype=np.int32)
    seat[wide, member] = np.arange(m, dtype=np.int32)
    going = np.zeros((rows, m), dtype=bool)
    every = np.arange(rows)

    limit = np.full(rows, m, dtype=np.int32)
    while True:
        current = group[every, member[every, np.maximum(limit - 1, 0)]]
        open_ = current > 0  # group 0 holds the separators
        if not open_.any():
            break
        r = np.repeat(np.flatnonzero(open_), (limit - current)[open_])
        here = current[r]
        first = np.cumsum((limit - current)[open_]) - (limit - current)[open_]
        i = member[r, here + np.arange(len(r)) - np.repeat(first, (limit - current)[open_])]
        # nearest earlier suffix of a smaller group, along pointers; members of one group shorten each other's way
        prev[r, i] = i - 1
        left = np.arange(len(r))
        while len(left):
            p = prev[r[left], i[left]]
            on = p >= 0
            left, p = left[on], p[on]
            on = group[r[left], p] >= here[left]
            left, p = left[on], p[on]
            prev[r[left], i[left]] = prev[r[left], p]
        p = prev[r, i]
        on = p >= 0
        key, times = np.unique(r[on].astype(np.int64) * m + p[on], return_counts=True)
        r, j = key // m, key % m
        g = group[r, j]
        on = g > 0
        r, j, g, times = r[on], j[on], g[on], times[on]
        if len(r):
            o = np.lexsort((times, g, r))
            r, j, g, times = r[o], j[o], g[o], times[o]
            n = len(r)
            run = np.ones(n, dtype=bool)
            run[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
            sub = run.copy()
            sub[1:] |= times[1:] != times[:-1]
            firsts = np.flatnonzero(run)
            ends = np.append(firsts[1:], n)
            end = np.repeat(ends, np.diff(np.append(firsts, n)))
            subs = np.flatnonzero(sub)
            moved = g[subs] + size[r[subs], g[subs]] - (end[subs] - subs)
            # the last places of each group are for those that move; who sits there takes the places they leave
            last = g + size[r, g]
            to = last - end + np.arange(n)
            sat, was = member[r, to], seat[r, j]
            going[r, j] = True
            stays, leaves = ~going[r, sat], was < last - (end - np.repeat(firsts, ends - firsts))
            going[r, j] = False
            member[r[leaves], was[leaves]] = sat[stays]
            seat[r[stays], sat[stays]] = was[leaves]
            member[r, to], seat[r, j] = j, to
            size[r[firsts], g[firsts]] -= (ends - firsts).astype(np.int32)
            lengths = np.diff(np.append(subs, n))
            size[r[subs], moved] = lengths
            group[r, j] = np.repeat(moved, lengths)
        limit = np.where(open_, current, 0)

    suffixes = np.zeros((rows, m), dtype=np.int32)
    free = np.broadcast_to(np.arange(m, dtype=np.int32), (rows, m)).copy()
    placed = t == 0
    zeros = placed.sum(1)
    places = np.where(np.arange(m) < zeros[:, None], order, 0)
    suffixes[:] = places
    for k in range(m):
        r, j = every, suffixes[:, k] - 1
        while True:
            on = j >= 0
            r, j = r[on], j[on]
            on = ~placed[r, j]
            r, j = r[on], j[on]
            if not len(r):
                break
            g = group[r, j]
            slot = free[r, g]
            suffixes[r, slot] = j
            free[r, g] = slot + 1
            placed[r, j] = True
            j = prev[r, j]
    return suffixes
