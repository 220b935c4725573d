"""Suffix arrays of many short strings at once, by linear grouping of Lyndon prefixes.

The construction sorts suffixes without renaming and recursion. Phase 1 holds the suffixes in groups
of one common prefix, at first their first symbol. Groups are processed in descending order: each
suffix of the group finds its previous smaller suffix over pointers, and that suffix's own prefix
grows by the group's; suffixes whose prefix grew form new groups right above what is left of
their old one, ordered by how often they grew. When all groups are processed, a group's common prefix is
its suffixes' longest Lyndon prefix. Phase 2 emits suffixes in ascending order: each emitted one
gives the next place in their groups to the suffixes whose Lyndon prefix ends where it starts,
which the same pointers lead to.

Every string is independent, so all strings take a step together: a step is a handful of array
operations over the current group of each.
"""

from __future__ import annotations

import numpy as np


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] times, and so on for each entry."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings laid end to end, each in its string's own range.

    symbols: not negative; starts: where each string starts, with the total length at the end.
    Each string ends in a symbol that is its least and occurs once.
    """
    n = int(starts[-1])
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(owner * (int(symbols.max()) + 1 if n else 1) + symbols, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    group = np.full(n + 1, -1, np.int64)  # of each suffix the first place of its group; n: none
    heads = np.flatnonzero(new)
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    length = np.zeros(n + 1, np.int64)  # of the group that starts at a place
    length[heads] = np.diff(np.append(heads, n))
    previous = np.concatenate([np.arange(n) - 1, [n]])
    previous[starts[:-1][sizes > 0]] = n
    moved = np.zeros(n + 1, bool)
    last = starts[1:][sizes > 0] - 1  # of each string the last place not yet processed
    bottom = starts[:-1][sizes > 0]
    while len(last):
        head = group[order[last]]
        members = order[spread(head, last - head + 1)]
        floor = np.repeat(head, last - head + 1)
        at = np.arange(len(members))
        to = previous[members]
        while len(at):
            at = at[group[to[at]] >= floor[at]]
            to[at] = previous[to[at]]
            previous[members[at]] = to[at]
        previous[members] = to
        grown, times = np.unique(to[to < n], return_counts=True)
        if len(grown):
            by = np.argsort(group[grown] * (n + 1) + times)
            grown, times = grown[by], times[by]
            old = group[grown]
            first = np.ones(len(grown), bool)
            first[1:] = old[1:] != old[:-1]
            run = np.flatnonzero(first)
            counts = np.diff(np.append(run, len(grown)))
            tail = old[run] + length[old[run]] - counts
            target = spread(tail, counts)
            moved[grown] = True
            out = order[target]
            out = out[~moved[out]]
            free = place[grown]
            free = free[free < np.repeat(tail, counts)]
            order[free], place[out] = out, free
            order[target], place[grown] = grown, target
            moved[grown] = False
            length[old[run]] -= counts
            first[1:] |= times[1:] != times[:-1]
            run = np.flatnonzero(first)
            counts = np.diff(np.append(run, len(grown)))
            length[target[run]] = counts
            group[grown] = np.repeat(target[run], counts)
        last = head - 1
        more = last >= bottom
        last, bottom = last[more], bottom[more]

    slot = np.arange(n + 1)  # at a group's first place the next one to give away
    out = np.full(n, -1, np.int64)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    some = sizes > 0
    out[starts[:-1][some]] = starts[1:][some] - 1  # the least suffix is the last symbol
    placed[starts[1:][some] - 1] = True
    lo, hi = starts[:-1][some], starts[1:][some]
    before = np.concatenate([np.arange(n) - 1, [n]])
    before[lo] = n
    step = lo.copy()
    while len(step):
        to = before[out[step]]
        while len(to := to[~placed[to]]):
            where = slot[group[to]]
            slot[group[to]] += 1
            out[where] = to
            placed[to] = True
            to = previous[to]
        step += 1
        more = step < hi
        step, hi = step[more], hi[more]
    return out


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the common prefix of its suffix and the one before in its string's order; 0 for the first."""
    n = int(starts[-1])
    ends = np.repeat(starts[1:], np.diff(starts))
    lcp = np.zeros(n, np.int64)
    at = np.ones(n, bool)
    at[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(at)
    a, b = sa[at], sa[at - 1]
    padded = np.append(symbols, -1)
    while len(at):
        room = (a < ends[at]) & (b < ends[at])
        same = room & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        at, a, b = at[same], a[same] + 1, b[same] + 1
        lcp[at] += 1
    return lcp


def previous_factors(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that also starts earlier in its string.

    Suffixes leave a list in suffix order from the last position on; what is next to a suffix when
    it leaves is its closest suffixes among the earlier ones.
    """
    n = int(starts[-1])
    sa = suffix_arrays(symbols, starts)
    lcp = np.append(common_prefixes(symbols, starts, sa), 0)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    some = np.diff(starts) > 0
    up, down = np.arange(n + 2) - 1, np.arange(n + 1) + 1
    up[0] = n
    lcp[starts[:-1][some]] = 0
    out = np.zeros(n, np.int64)
    now, low = starts[1:][some] - 1, starts[:-1][some]
    while len(now):
        p = place[now]
        nxt = down[p]
        inner = nxt < n
        right = np.where(inner, lcp[np.minimum(nxt, n)], 0)
        out[now] = np.maximum(lcp[p], right)
        lcp[nxt[inner]] = np.minimum(lcp[p], right)[inner]
        down[up[p]] = nxt
        up[nxt] = up[p]
        now = now - 1
        more = now >= low
        now, low = now[more], low[more]
    return out
