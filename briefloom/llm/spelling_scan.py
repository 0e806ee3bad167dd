"""Pairs of words one edit apart, by one scan of sorted lists.

The lists are sorted by code points. For every word the scan walks the words behind it in its list and keeps the rows of
the edit matrix, three cells wide, one per code point of the word it stands at. The next word shares a prefix with it,
known from the lengths of the common prefixes of neighbours: rows of that prefix stay. As soon as no cell of a row is at
most one, every word with that prefix is too far, and the scan goes to the first word that does not share it, by pointers
to the next shorter common prefix. All words are scanned in step.
"""

from __future__ import annotations

import numpy as np

_FAR = 2


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the offsets of the words in it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def common_prefixes(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every word with the one before it; the first has none."""
    sizes = np.diff(offsets)
    lcp = np.zeros(len(sizes), np.int64)
    alive = np.arange(1, len(sizes))
    while len(alive):
        at = lcp[alive]
        alive = alive[(at < sizes[alive]) & (at < sizes[alive - 1])]
        at = lcp[alive]
        alive = alive[points[offsets[alive] + at] == points[offsets[alive - 1] + at]]
        lcp[alive] += 1
    return lcp


def next_shorter(lcp: np.ndarray) -> np.ndarray:
    """For every place the first later one with a shorter common prefix."""
    out = np.full(len(lcp), len(lcp), np.int64)
    stack: list[int] = []
    for i, n in enumerate(lcp.tolist()):
        while stack and lcp[stack[-1]] > n:
            out[stack.pop()] = i
        stack.append(i)
    return out


def pairs(points: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) of all pairs of words of one group that are exactly one edit apart.

    Words of a group stand together, sorted and without repeats; ``group`` is its number for each word.
    """
    n = len(group)
    sizes = np.diff(offsets)
    lcp = common_prefixes(points, offsets)
    fresh = np.ones(n, bool)
    fresh[1:] = group[1:] != group[:-1]
    lcp[fresh] = -1  # a scan ends where its group does
    shorter = next_shorter(lcp)
    lcp, shorter = np.append(lcp, -1), np.append(shorter, n)
    # Row d of a word holds cells for d - 1, d and d + 1 of its own code points. Where the words agree they are 1, 0, 1.
    base = offsets[:-1] + 2 * np.arange(n)
    rows = np.empty((offsets[-1] + 2 * n + 2, 3), np.int8)
    rows[:] = (1, 0, 1)
    rows[base, 0] = _FAR
    rows[base + sizes, 2] = _FAR
    padded = np.append(points, [-1, -1, -1]).astype(np.int32)

    query = np.flatnonzero(lcp[1 : n + 1] >= 0)
    place = query + 1
    depth = np.minimum(lcp[place], sizes[query])
    first, second = [], []
    while len(query):
        ended = depth == sizes[place]
        # Words that are read to their end: the distance stands in the cell of the scanning word's own end.
        if ended.any():
            q, p, d = query[ended], place[ended], depth[ended]
            column = sizes[q] - d + 1
            near = (column >= 0) & (column <= 2)
            near[near] = rows[base[q[near]] + d[near], column[near]] == 1
            first.append(q[near])
            second.append(p[near])
        dead = np.zeros(len(query), bool)
        go = np.flatnonzero(~ended)
        if len(go):
            q, d = query[go], depth[go]
            char = points[offsets[place[go]] + d]
            at = base[q] + d
            old = rows[at]
            own = offsets[q] + d
            left = np.where(d >= 1, padded[own - 1], -1)
            inside, beyond = d < sizes[q], d + 1 < sizes[q]
            a = np.minimum(old[:, 0] + (left != char), old[:, 1] + 1)
            b = np.minimum(np.minimum(old[:, 1] + (padded[own] != char), old[:, 2] + 1), a + 1)
            b = np.where(inside, b, _FAR)
            c = np.where(beyond, np.minimum(old[:, 2] + (padded[own + 1] != char), b + 1), _FAR)
            a = np.where(d <= sizes[q], a, _FAR)
            new = np.minimum(np.stack([a, b, c], 1), _FAR).astype(np.int8)
            far = new.min(1) > 1
            kept = ~far
            rows[at[kept] + 1] = new[kept]
            depth[go[kept]] += 1
            dead[go[far]] = True
        # After a word's end the next word comes; after a dead prefix of depth + 1 the first word without it.
        moving = np.flatnonzero(ended | dead)
        if len(moving):
            limit = np.where(dead[moving], depth[moving], np.iinfo(np.int64).max)
            to = place[moving] + 1
            while True:
                inside = lcp[to] > limit
                if not inside.any():
                    break
                to = np.where(inside, shorter[to], to)
            place[moving] = to
            depth[moving] = np.minimum(depth[moving], lcp[to])
            over = lcp[place] < 0
            if over.any():
                query, place, depth = query[~over], place[~over], depth[~over]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])
