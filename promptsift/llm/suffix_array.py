"""Suffix arrays by linear grouping, of many short texts at a time.

Phase one sorts suffixes into groups by their longest Lyndon prefix. A text's groups are gone
through in descending order: each suffix of the highest group left is followed by its pointer
to the nearest earlier suffix of a lower group, and what is pointed at moves to a group of its
own, just above the rest of its group. Pointers skip what is higher, as groups are only ever
refined. Phase two emits each group's order: suffixes in ascending order put the suffix before
them, and what that points at, in the next place of its group. There are no ranks that are
renamed and sorted again.

Both phases take a step in every text (a lane) at once, so that numpy works on arrays of as
many members as there are lanes. A lane's own steps are linear in its length.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of sizes[k] numbers each, joined."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)


def grouped(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's group, named by its first place, and the pointer to the previous smaller one (-1: none).

    text: the lanes' bytes, joined; bounds: where lanes begin, and the end.
    """
    n, low = len(text), bounds[:-1]
    lane = np.repeat(np.arange(len(low)), np.diff(bounds))
    first = lane << 8 | text
    order = np.argsort(first, kind="stable")
    begins = np.flatnonzero(np.diff(first[order], prepend=-1))
    group, place, previous = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, -1)
    group[order] = np.repeat(begins, np.diff(begins, append=n))
    place[order] = np.arange(n)
    end = np.zeros(n + 1, np.int64)
    end[begins] = np.append(begins[1:], n)
    moving = np.zeros(n, bool)
    top = bounds[1:].copy()
    active = np.flatnonzero(top > low)
    while len(active):
        stop = top[active]
        start = group[order[stop - 1]]
        top[active] = start
        sizes = stop - start
        members = np.sort(order[ranges(start, sizes)])  # lanes stay in their order
        own, least = np.repeat(start, sizes), np.repeat(low[active], sizes)
        before = members - 1
        before[before < least] = -1
        walking = np.flatnonzero(before >= 0)
        while len(walking):
            walking = walking[group[before[walking]] > own[walking]]
            before[walking] = previous[before[walking]]
            walking = walking[before[walking] >= 0]
        # members that follow a member of their group share what the first of them points at
        heads = np.flatnonzero((before < 0) | (group[before] < own))
        times = np.diff(heads, append=len(members))
        target = before[heads]
        previous[members] = np.repeat(target, times)
        seen = np.flatnonzero(target >= 0)
        if len(seen):
            _split(target[seen], times[seen], order, place, group, end, moving)
        active = active[start > low[active]]
    return group, previous


def _split(target: np.ndarray, times: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray, end: np.ndarray, moving: np.ndarray) -> None:
    """Moves targets above the rest of their groups, those that more members follow above others."""
    by = np.lexsort((times, group[target])) if times.max() > 1 else np.argsort(group[target], kind="stable")
    target, times, old = target[by], times[by], group[target[by]]
    fresh = np.append(True, old[1:] != old[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(at, append=len(target))
    begin = end[old[at]] - counts
    slots = ranges(begin, counts)
    there, were = order[slots], place[target]
    moving[target] = True
    out = there[~moving[there]]
    moving[target] = False
    free = were[were < np.repeat(begin, counts)]
    order[free], place[out] = out, free
    order[slots], place[target] = target, slots
    fresh[1:] |= times[1:] != times[:-1]
    first = np.flatnonzero(fresh)
    names = slots[first]
    group[target] = np.repeat(names, np.diff(first, append=len(target)))
    end[old[at]] = begin
    end[names] = slots[np.append(first[1:], len(slots)) - 1] + 1


def suffix_arrays(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes' bytes joined, their bounds, and their suffix arrays joined, as places in the joined bytes.

    Lanes are joined from the longest to the shortest; an end of a lane is less than any byte.
    """
    sizes = np.array([len(x) for x in lanes], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    text = np.concatenate(lanes) if lanes else np.empty(0, np.uint8)
    group, previous = grouped(text, bounds)
    low, n = bounds[:-1], len(text)
    free = np.arange(n)
    out, placed = np.empty(n, np.int64), np.zeros(n, bool)
    counts = np.searchsorted(-sizes, -np.arange(-1, int(sizes.max(initial=0))), side="left")  # lanes longer than -1, 0, 1, ...
    for r in range(-1, int(sizes.max(initial=0))):
        live = low[: counts[r + 1]]
        # rank r of each lane, or the empty suffix, which is less than all
        suffix = (bounds[1 : len(live) + 1] if r < 0 else out[live + r]) - 1
        suffix = suffix[suffix >= live]
        while len(suffix):
            suffix = suffix[~placed[suffix]]
            own = group[suffix]
            out[free[own]] = suffix
            free[own] += 1
            placed[suffix] = True
            suffix = previous[suffix]
            suffix = suffix[suffix >= 0]
    return text, bounds, out
