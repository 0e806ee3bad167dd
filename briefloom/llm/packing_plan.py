"""The packing plan: which lengths share a window, solved on the histogram of lengths alone.

1. Shallow combinations: all sets of two or three lengths that fill the window exactly.
2. Repeat counts: non-negative least squares against the histogram. Columns enter where the rest is largest, and the
   entered ones are solved again by accelerated projected gradients, until no column would gain.
3. Rounding, largest count first, never beyond what the histogram holds.
4. The rest is packed greedily, longest first, each into the smallest gap that takes it. Then the emptiest windows are
   emptied again, and what they held is poured into the gaps of the others, cut where a gap ends.

Every step moves whole ranges of equal lengths. Of more than ``_AT_ONCE`` documents, the plan for a whole fraction of the
histogram is repeated so many times, and what the division leaves is planned after it: the size of a plan depends on the
window, and only by a logarithm on the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np

_ROUNDS = 40
_STEPS = 150
_AT_ONCE = 1 << 20


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths in ascending order (0: none) that occur in the histogram and add up to the window."""
    there = np.flatnonzero(counts[1:window]) + 1
    present = np.zeros(window + 1, bool)
    present[there] = True
    second = there[(there * 2 <= window) & present[window - there]]
    rows = [np.stack([np.zeros_like(second), second, window - second], 1)]
    for a in there[there * 3 <= window]:
        b = there[(there >= a) & (there <= (window - a) // 2)]
        b = b[present[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def repeat_counts(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that take part, and their non-negative least-squares counts."""
    target = counts.astype(float)
    target[0] = 0
    chosen, x = np.zeros(0, np.int64), np.zeros(0)
    if not len(columns):
        return chosen, x
    rest = target.copy()
    wide = columns.astype(np.intp)
    for _ in range(_ROUNDS):
        gain = rest[wide].sum(1)
        likely = np.argsort(-gain, kind="stable")[: 4 * len(target)]
        likely = likely[gain[likely] > 0.5]
        taken, fresh = set(), []
        for i, lengths in zip(likely.tolist(), wide[likely].tolist()):
            own = {n for n in lengths if n}
            if not own & taken:
                taken |= own
                fresh.append(i)
        new = np.setdiff1d(np.array(fresh, np.int64), chosen)
        if not len(new):
            break
        chosen, x = np.concatenate([chosen, new]), np.concatenate([x, np.zeros(len(new))])
        x = _descend(wide[chosen], x, target)
        chosen, x = chosen[x > 0], x[x > 0]
        rest = target - _covered(wide[chosen], x, len(target))
    return chosen, x


def _covered(columns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), n)
    out[0] = 0
    return out


def _descend(columns: np.ndarray, x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Projected gradient steps with momentum; the step of each column is bounded by its overlap with all others."""
    n = len(target)
    step = 1 / np.maximum(_covered(columns, np.ones(len(x)), n)[columns].sum(1), 1e-9)
    ahead, pace = x, 1.0
    for _ in range(_STEPS):
        gradient = (_covered(columns, ahead, n) - target)[columns]
        moved = np.maximum(0, ahead - step * np.where(columns > 0, gradient, 0).sum(1))
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / quicker * (moved - x)
        x, pace = moved, quicker
    return x


@dataclass(frozen=True)
class Pieces:
    """``count`` documents with a rest of ``length`` tokens, from number ``first``: tokens ``start`` to ``start + size``."""

    length: int
    first: int
    start: int
    size: int

    def later(self, by: int) -> Pieces:
        return Pieces(self.length, self.first + by, self.start, self.size)


@dataclass
class Windows:
    """``count`` windows alike, numbered from ``first``, each filled to ``filled``."""

    first: int
    count: int
    filled: int = 0
    held: list[Pieces] = field(default_factory=list)

    def split(self, count: int) -> tuple[Windows, Windows | None]:
        if count == self.count:
            return self, None
        after = Windows(self.first + count, self.count - count, self.filled, [p.later(count) for p in self.held])
        return Windows(self.first, count, self.filled, list(self.held)), after

    def add(self, piece: Pieces) -> None:
        self.held.append(piece)
        self.filled += piece.size


@dataclass
class Plan:
    """Where the rests go: rows of (length, first number, count, start, size, window, offset), and the windows used."""

    rows: np.ndarray
    n_windows: int
    n_solved: int  # windows that the solved combinations fill


def make_plan(counts: np.ndarray, window: int) -> Plan:
    """``counts[n]``: documents whose rest has ``n`` tokens, 0 < n < window."""
    left = counts.astype(np.int64)
    first, parts, n_windows, n_solved = np.zeros_like(left), [], 0, 0
    while True:
        times = max(1, int(left.sum()) // _AT_ONCE)
        part = _plan_once(left // times, window)
        rows = part.rows * np.array([1, times, times, 1, 1, times, 1])
        rows[:, 1] += first[rows[:, 0]]
        rows[:, 5] += n_windows
        parts.append(rows)
        n_windows, n_solved = n_windows + times * part.n_windows, n_solved + times * part.n_solved
        first, left = first + left // times * times, left % times
        if not left.any():
            return Plan(np.concatenate(parts), n_windows, n_solved)


def _plan_once(counts: np.ndarray, window: int) -> Plan:
    left = counts.copy()
    left[0] = 0
    used = np.zeros_like(left)
    columns = combinations(left, window)
    chosen, x = repeat_counts(columns, left)
    made: list[Windows] = []
    n_windows = 0

    def take(length: int, count: int) -> int:
        first = int(used[length])
        used[length] += count
        left[length] -= count
        return first

    for i in np.argsort(-x, kind="stable").tolist():
        lengths = [n for n in columns[chosen[i]].tolist() if n]
        repeats = min(round(x[i]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if repeats > 0:
            pack = Windows(n_windows, repeats)
            for n in lengths:
                pack.add(Pieces(n, take(n, repeats), 0, n))
            n_windows += repeats
            made.append(pack)
    n_solved = n_windows
    rest = [(n, int(left[n])) for n in range(window - 1, 0, -1) if left[n]]
    loose, n_windows = _best_fit([(Pieces(n, take(n, c), 0, n), c) for n, c in rest], window, n_windows)
    loose, n_windows = _pour(loose, window, n_solved, n_windows)
    rows = []
    for pack in made + loose:
        offset = 0
        for p in pack.held:
            rows.append((p.length, p.first, pack.count, p.start, p.size, pack.first, offset))
            offset += p.size
    return Plan(np.array(rows, np.int64).reshape(-1, 7), n_windows, n_solved)


def _best_fit(items: list[tuple[Pieces, int]], window: int, n_windows: int) -> tuple[list[Windows], int]:
    open_by_gap: dict[int, list[Windows]] = {}
    gaps: list[int] = []

    def put(pack: Windows) -> None:
        gap = window - pack.filled
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            insort(gaps, gap)
        open_by_gap[gap].append(pack)

    for piece, count in items:
        while count:
            at = bisect_left(gaps, piece.size)
            if at < len(gaps):
                gap = gaps[at]
                pack = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap], gaps[at]
                pack, other = pack.split(min(count, pack.count))
                if other:
                    put(other)
            else:
                each = max(1, window // piece.size)  # of the longest left, as many as a window takes
                pack = Windows(n_windows, max(1, count // each))
                n_windows += pack.count
            pack.add(piece)
            piece, count = piece.later(pack.count), count - pack.count
            put(pack)
    return [p for packs in open_by_gap.values() for p in packs], n_windows


def _pour(packs: list[Windows], window: int, first: int, n_windows: int) -> tuple[list[Windows], int]:
    """Empty the windows that are not needed, fill the gaps of the others, and number the windows anew from ``first``."""
    tokens = sum(p.filled * p.count for p in packs)
    surplus = n_windows - first - -(-tokens // window)
    packs = sorted(packs, key=lambda p: (-p.filled, p.first))
    poured: list[tuple[Pieces, int]] = []
    while surplus > 0:
        pack = packs.pop()
        if pack.count > surplus:
            keep, pack = pack.split(pack.count - surplus)
            packs.append(keep)
        surplus -= pack.count
        poured += [(p, pack.count) for p in pack.held]
    done = [p for p in packs if p.filled == window]
    gaps = [p for p in packs if p.filled < window]  # fullest first: the widest gap is filled first, from the end
    poured.sort(key=lambda x: (x[0].size, x[0].length, x[0].first))
    while poured:
        piece, count = poured.pop()
        pack = gaps.pop()
        together = min(count, pack.count)
        pack, other = pack.split(together)
        if other:
            gaps.append(other)
        if count > together:
            poured.append((piece.later(together), count - together))
        gap = window - pack.filled
        size = min(gap, piece.size)
        pack.add(Pieces(piece.length, piece.first, piece.start, size))
        if size < piece.size:
            poured.append((Pieces(piece.length, piece.first, piece.start + size, piece.size - size), together))
        (done if pack.filled == window else gaps).append(pack)
    done += gaps
    number = first
    for pack in done:
        pack.first = number
        number += pack.count
    return done, number
