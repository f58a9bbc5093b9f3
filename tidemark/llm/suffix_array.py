"""Suffix arrays by linear grouping (Baier), for many short strings in lock step.

Phase 1 sorts suffixes into groups by their Lyndon prefix. Groups are handled from the
highest down. For every suffix of the group at hand, the previous-smaller pointer leads to
the closest earlier suffix in a lower group; suffixes that are pointed at move to a new
group right above the rest of their old one, ordered by how many pointers reach them.
Phase 2 walks the array from its start: the suffix left of each one found, and those on
its chain of previous-smaller pointers, are next in their groups. Nothing is renamed or
solved recursively.

The steps of one string follow each other, but strings are independent: each numpy
operation below takes one group (phase 1) or one suffix (phase 2) of every string.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges, and for each the number of its range."""
    of = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(of)) - first[of] + starts[of], of


def _group(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final group start and previous-smaller pointer (-1: none) of every suffix."""
    n = len(text)
    string = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((np.arange(n), text, string))
    index = np.empty(n, np.int64)
    index[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (string[order][1:] != string[order][:-1])
    group = np.empty(n, np.int64)
    group[order] = np.nonzero(new)[0][np.cumsum(new) - 1]
    size = np.zeros(n, np.int64)
    np.add.at(size, group, 1)
    prev = np.full(n, -1, np.int64)
    top, low = ends.copy(), starts.copy()
    mark = np.zeros(n, bool)
    while len(top):
        g = group[order[top - 1]]
        at, of = _ranges(g, top - g)
        members = order[at]
        floor, bound = g[of], low[of]
        # Walk left past everything that is not in a lower group.
        left = members - 1
        open_ = np.nonzero(left >= bound)[0]
        while len(open_):
            here = left[open_]
            there = group[here]
            high = there >= floor[open_]
            open_, here, there = open_[high], here[high], there[high]
            left[open_] = np.where(there > floor[open_], prev[here], here - 1)
            open_ = open_[left[open_] >= bound[open_]]
        prev[members] = left = np.where(left >= bound, left, -1)
        target = np.sort(left[left >= 0])
        if len(target):
            first = np.nonzero(np.concatenate([[True], target[1:] != target[:-1]]))[0]
            count = np.diff(np.concatenate([first, [len(target)]]))
            target = target[first]
            by = np.lexsort((count, group[target]))
            target, count = target[by], count[by]
            old = group[target]
            heads = np.nonzero(np.concatenate([[True], old[1:] != old[:-1]]))[0]
            moved = np.diff(np.concatenate([heads, [len(old)]]))
            of = np.repeat(np.arange(len(heads)), moved)
            place = old + size[old] - moved[of] + (np.arange(len(old)) - heads[of])
            # Swap the moved suffixes with those that fill the tail of their groups.
            out = order[place]
            mark[target] = True
            spare = out[~mark[out]]
            mark[target] = False
            mark[place] = True
            holes = index[target]
            holes = np.sort(holes[~mark[holes]])
            mark[place] = False
            spare = spare[np.argsort(group[spare], kind="stable")]
            order[holes], index[spare] = spare, holes
            order[place], index[target] = target, place
            fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (count[1:] != count[:-1])])
            begins = np.nonzero(fresh)[0]
            start = place[begins][np.cumsum(fresh) - 1]
            size[old[heads]] -= moved
            size[place[begins]] += np.diff(np.append(begins, len(place)))
            # A group that moved as a whole keeps its place: its start is the old one.
            group[target] = start
        top = g
        still = top > low
        top, low = top[still], low[still]
    return group, prev


def suffix_arrays(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings ``text[starts[k]:ends[k]]``, one behind the other.

    The strings fill ``text`` in order, and each ends in a symbol that is smaller than all
    others in it. Entries are positions in ``text``.
    """
    group, prev = _group(text, starts, ends)
    n = len(text)
    free, placed = np.arange(n), np.zeros(n, bool)
    out = np.full(n, -1, np.int64)
    out[starts] = ends - 1
    placed[ends - 1] = True
    at, end = starts.copy(), ends.copy()
    now = out[at] - 1
    while len(at):
        # Left of a string's start, and for the pointer -1, stands a last suffix: placed.
        do = ~placed[now]
        j = now[do]
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        placed[j] = True
        now[do] = prev[j]
        go = ~do
        at[go] += 1
        alive = at < end
        if not alive.all():
            at, end, now, go = at[alive], end[alive], now[alive], go[alive]
        now[go] = out[at[go]] - 1
    return out


def suffix_array(data: bytes) -> np.ndarray:
    """The suffix array of one byte string."""
    text = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]])
    return suffix_arrays(text, np.array([0]), np.array([len(text)]))[1:]
