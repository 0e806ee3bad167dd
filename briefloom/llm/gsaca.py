"""Suffix arrays by linear grouping, for many short texts at a time.

Suffixes start out grouped by their first symbol. Groups are taken in descending order. Every suffix of a group points
to its previous smaller one: the nearest earlier position whose group is lower. Positions that are pointed at continue
with the group's Lyndon word, the more often the later they sort: they leave their group for new ones right above the
rest of it. In the end a group holds the suffixes with one Lyndon prefix. A second pass walks through the order from
its start and puts the position in front of each suffix, and those its pointers lead to, next into their groups.
No group is renamed and no text is sorted again.

All texts of a batch advance together, one group of each per step, so that a step is a few array operations.
"""

from __future__ import annotations

import numpy as np


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. start + size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix array of every text, one after another, as places in ``symbols``.

    ``symbols``: all texts behind one another, text k at ``offsets[k]:offsets[k + 1]``. Each text must end with a symbol
    that is smaller than all others in it. No text may be empty.
    """
    n, k = len(symbols), len(offsets) - 1
    if not k:
        return np.zeros(0, np.int64)
    # One place in front of every text stands for "no previous smaller suffix".
    lane = np.repeat(np.arange(k), np.diff(offsets))
    at = np.arange(n) + lane + 1
    base = offsets[:-1] + np.arange(k) + 1
    top = offsets[1:] + np.arange(k) + 1
    total = n + k + 1
    group = np.full(total, -1, np.int32)  # first slot of the suffix's group: groups compare like their slots
    size = np.zeros(total, np.int32)  # by first slot
    slots = np.full(total, -1, np.int32)  # suffixes in the order of their groups
    slot_of = np.full(total, -1, np.int32)
    order = np.argsort(lane * (int(symbols.max()) + 1) + symbols, kind="stable")
    slots[at] = at[order]
    slot_of[slots[at]] = at
    head = np.concatenate([[True], (lane[order][1:] != lane[order][:-1]) | (symbols[order][1:] != symbols[order][:-1])])
    first = at[head]
    size[first] = np.diff(np.append(np.flatnonzero(head), n))
    group[slots[at]] = np.repeat(first, size[first])
    previous = np.arange(-1, total - 1, dtype=np.int32)

    live_base, live_top = base.copy(), top.copy()
    while len(live_top):
        start = group[slots[live_top - 1]]
        members = slots[_spread(start, live_top - start)]
        own = np.repeat(start, live_top - start)
        pending, bound = members, own
        while len(pending):
            to = previous[pending]
            far = group[to] >= bound
            pending, bound, to = pending[far], bound[far], to[far]
            previous[pending] = previous[to]
        to = previous[members]
        to = np.sort(to[group[to] >= 0])
        if len(to):
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            moved, times = to[edge], np.diff(np.append(edge, len(to)))
            old = group[moved]
            by = np.lexsort((times, old))
            moved, times, old = moved[by], times[by], old[by]
            fresh = np.concatenate([[True], old[1:] != old[:-1]])
            starts_old = np.flatnonzero(fresh)
            leaving = np.diff(np.append(starts_old, len(moved)))
            tail = old[starts_old] + size[old[starts_old]] - leaving  # first slot of those that leave, by old group
            goal = np.repeat(tail - starts_old, leaving) + np.arange(len(moved))
            # Those in the way take the slots that become free.
            displaced = slots[goal]
            place = slot_of[moved]
            limit = np.repeat(tail, leaving)
            slot_of[moved] = goal
            free = place < limit
            goes = ~np.isin(displaced, moved, assume_unique=True)
            slots[goal] = moved
            slots[place[free]] = displaced[goes]
            slot_of[displaced[goes]] = place[free]
            # New groups: one for every number of times, the rest of the old group stays in front of them.
            part = fresh | np.concatenate([[True], times[1:] != times[:-1]])
            part_at = np.flatnonzero(part)
            part_size = np.diff(np.append(part_at, len(moved)))
            size[old[starts_old]] -= leaving
            size[goal[part_at]] = part_size
            group[moved] = np.repeat(goal[part_at], part_size)
        live_top = start
        more = live_top > live_base
        live_base, live_top = live_base[more], live_top[more]

    # Second pass. ``next_slot`` of a group's first slot: where its next suffix goes.
    result = np.full(total, -1, np.int32)
    next_slot = np.arange(total, dtype=np.int32)
    placed = np.zeros(total, bool)
    result[base] = top - 1
    placed[top - 1] = True
    next_slot[base] += 1
    cursor, end = base.copy(), top
    chain = result[cursor] - 1
    while len(cursor):
        idle = (group[chain] < 0) | placed[chain]
        going = ~idle
        j = chain[going]
        g = group[j]
        result[next_slot[g]] = j
        next_slot[g] += 1
        placed[j] = True
        chain[going] = previous[j]
        cursor[idle] += 1
        done = cursor >= end
        if done.any():
            keep = ~done
            cursor, end, chain, idle = cursor[keep], end[keep], chain[keep], idle[keep]
        chain[idle] = result[cursor[idle]] - 1
    return (result[at] - lane - 1).astype(np.int64)
