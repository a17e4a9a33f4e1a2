"""Suffix arrays by linear grouping (Baier's two-phase construction), many small texts in step.

Phase 1 keeps suffixes in groups of a common prefix, in lexicographic order, and processes groups
from the highest down.  Each suffix of the current group points at its previous smaller suffix,
the nearest one to the left in a lower group; the suffixes pointed at are moved, by how often
they are pointed at, into new groups right above their old ones.  In the end a group holds the
suffixes with one longest Lyndon prefix.  Phase 2 walks the order from the smallest suffix:
whatever suffix i is emitted, the suffix before it and its chain of previous smaller ones take
the next free places of their groups.  No suffix is renamed or sorted again.

`order` runs that for all texts ("lanes") of a batch at once: a step handles the current group of
every lane that is not finished.  `order_one` is the same walk for one long text.
"""

from __future__ import annotations

import numpy as np


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0], then the same for the next."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def order(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions of all lanes' suffixes, each lane's in lexicographic order.

    text: symbols of all lanes, one after another; edges: lane bounds.  Each lane must end in a
    symbol that is smaller than all others in it and occurs once.
    """
    n = len(text)
    lane_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    left = edges[:-1][lane_of]
    sa = np.lexsort((text, lane_of))
    head = np.ones(n, bool)
    head[1:] = (lane_of[1:] != lane_of[:-1]) | (text[sa][1:] != text[sa][:-1])
    starts = np.flatnonzero(head)
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[sa] = starts[np.cumsum(head) - 1]
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    prev = np.full(n, -1)
    marked = np.zeros(n, bool)

    low, end = edges[:-1] + 1, edges[1:].copy()
    while True:
        live = end > low
        if not live.all():
            low, end = low[live], end[live]
        if not len(end):
            break
        gs = group[sa[end - 1]]
        k = end - gs
        members = sa[ragged(gs, k)]
        g = np.repeat(gs, k)
        p = np.where(members > left[members], members - 1, -1)
        todo = np.flatnonzero((p >= 0) & (group[p] > g))
        while len(todo):
            p[todo] = prev[p[todo]]
            todo = todo[(p[todo] >= 0) & (group[p[todo]] > g[todo])]
        prev[members] = p
        todo = np.flatnonzero((p >= 0) & (group[p] == g))
        while len(todo):
            p[todo] = prev[p[todo]]
            prev[members[todo]] = p[todo]
            todo = todo[(p[todo] >= 0) & (group[p[todo]] == g[todo])]
        end = gs
        p = p[p >= 0]
        if not len(p):
            continue
        p.sort()
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(p)))
        p = p[at]
        h = group[p]
        o = np.lexsort((times, h))
        p, h, times = p[o], h[o], times[o]
        first = np.ones(len(p), bool)
        first[1:] = h[1:] != h[:-1]
        h_at = np.flatnonzero(first)
        count = np.diff(np.append(h_at, len(p)))
        hs = h[h_at]
        back = ragged(hs + size[hs] - count, count)
        marked[p] = True
        occupant = sa[back]
        moved = occupant[~marked[occupant]]
        marked[p] = False
        if len(moved):
            was = place[p]
            hole = was[was < np.repeat(hs + size[hs] - count, count)]
            sa[hole] = moved
            place[moved] = hole
        sa[back] = p
        place[p] = back
        size[hs] -= count
        first[1:] |= times[1:] != times[:-1]
        run = np.flatnonzero(first)
        size[back[run]] = np.diff(np.append(run, len(p)))
        group[p] = back[run][np.cumsum(first) - 1]

    out = np.full(n, -1)
    free = np.arange(n)
    t, stop = edges[:-1].copy(), edges[1:]
    out[t] = stop - 1
    placed = np.zeros(n, bool)
    placed[stop - 1] = True
    while len(t):
        j = out[t] - 1
        j = j[j >= left[out[t]]]
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
            j = j[j >= 0]
            j = j[~placed[j]]
        t = t + 1
        live = t < stop
        t, stop = t[live], stop[live]
    return out


def order_one(text: np.ndarray) -> np.ndarray:
    """The same for one text whose last symbol is its smallest and occurs once."""
    n = len(text)
    sa = np.argsort(text, kind="stable").tolist()
    s = text.tolist()
    group, place, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, x in enumerate(sa):
        if i and s[x] != s[sa[i - 1]]:
            start = i
        group[x], place[x] = start, i
        size[start] += 1
    end = n
    while end > 1:
        gs = group[sa[end - 1]]
        members = sorted(sa[gs:end])
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= gs:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = gs
        split: dict[tuple[int, int], list[int]] = {}
        for p, c in times.items():
            split.setdefault((group[p], -c), []).append(p)
        for h, c in sorted(split):  # the most often pointed at first, hence highest
            new = split[h, c]
            for p in new:
                size[h] -= 1
                top = h + size[h]
                other, hole = sa[top], place[p]
                sa[hole], place[other] = other, hole
                sa[top], place[p] = p, top
            first = h + size[h]
            for p in new:
                group[p] = first
            size[first] = len(new)
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for t in range(n):
        j = out[t] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return np.array(out)
