"""How many sequences of which lengths: a packing plan for a histogram of lengths, by linear grouping.

Input and work depend on the number of distinct lengths, which the capacity bounds, never on the number of documents.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np

#: Lengths above a share of the capacity are grouped, into so many groups at most; the rest fill gaps. The best of these plans is taken.
SETTINGS = ((1 / 3, 64), (1 / 5, 64), (1 / 8, 48))


@dataclass
class Run:
    """``count`` sequences of equal make-up; slots are (length, first rank among the documents of that length)."""
    count: int
    left: int
    slots: list[tuple[int, int]] = field(default_factory=list)

    def split(self, count: int) -> "Run":
        """Takes the first ``count`` sequences out of this run."""
        first = Run(count, self.left, list(self.slots))
        self.count -= count
        self.slots = [(size, rank + count) for size, rank in self.slots]
        return first


def groups_of(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """(size, members): items from the longest down in groups of equal cardinality, each rounded up to its longest."""
    total = int(counts.sum())
    each = -(-total // groups)
    ends = np.cumsum(counts[::-1])
    down = lengths[::-1]
    return [(int(down[np.searchsorted(ends, k, side="right")]), min(each, total - k)) for k in range(0, total, each)]


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The number of each size that fits a sequence and is worth most: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.argsort(-sizes):
        size = int(sizes[k])
        if worth[k] <= 1e-12:
            continue
        for start in range(size, capacity + 1, size):          # one more of this size than in the stretch before
            end = min(start + size, capacity + 1)
            other = best[start - size:end - size] + worth[k]
            better = other > best[start:end] + 1e-12
            best[start:end][better] = other[better]
            last[start:end][better] = k
    out, room = np.zeros(len(sizes)), int(np.argmax(best))
    while last[room] >= 0:
        out[last[room]] += 1
        room -= int(sizes[last[room]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) that covers the demand with the fewest sequences if times may be broken: column generation with a revised simplex."""
    n = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1 / np.diag(basis))
    times = inverse @ demand
    for step in range(rounds):
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            times = np.maximum(inverse @ demand, 0)
        worth = np.ones(n) @ inverse
        pattern = best_pattern(sizes, worth, capacity)
        if pattern @ worth <= 1 + 1e-7:
            break
        enter = inverse @ pattern
        ratio = np.full(n, np.inf)
        np.divide(times, enter, out=ratio, where=enter > 1e-9)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        times = np.maximum(times - ratio[out] * enter, 0)
        times[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / enter[out]
        inverse = inverse - np.outer(enter, row)
        inverse[out] = row
    return [(basis[:, k], float(times[k])) for k in range(n) if times[k] > 1e-9]


class Gaps:
    """Runs by the room that is left in their sequences."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[Run]] = {}

    def add(self, run: Run) -> None:
        if run.count:
            if run.left not in self.runs:
                bisect.insort(self.rooms, run.left)
                self.runs[run.left] = []
            self.runs[run.left].append(run)

    def tightest(self, size: int) -> Run | None:
        """A run with the least room that holds ``size``."""
        k = bisect.bisect_left(self.rooms, size)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(k)
        return run


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Arrays size, first, last, sequence, offset, sorted by (size, first): the documents of a length with ranks in [first, last) go, one
    each, into the sequences from ``sequence`` on, at ``offset``. Every rank of every length is placed once."""
    runs = min((grouped(histogram, capacity, *setting) for setting in SETTINGS), key=lambda runs: sum(r.count for r in runs))
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for size, first in run.slots:
            rows.append((size, first, first + run.count, sequence, offset))
            offset += size
        sequence += run.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "last", "sequence", "offset"), table.T.copy()))


def grouped(histogram: dict[int, int], capacity: int, large: float, groups: int) -> list[Run]:
    """A packing by linear grouping of all lengths above ``large`` times the capacity."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    used = {int(k): 0 for k in lengths}
    total = dict(zip(map(int, lengths), map(int, counts)))
    gaps = Gaps()
    big = lengths > capacity * large
    if big.any():
        rounded = groups_of(lengths[big], counts[big], groups)
        merged: dict[int, int] = {}
        for size, members in rounded:
            merged[size] = merged.get(size, 0) + members
        sizes = np.array(sorted(merged, reverse=True), dtype=np.int64)
        demand = np.array([merged[int(s)] for s in sizes], dtype=np.float64)
        # The documents of a rounded size, longest first, as a list of (length, number).
        stock: list[list[list[int]]] = []
        left, down = dict(total), [int(k) for k in lengths[::-1]]
        at = 0
        for size in sizes:
            need, own = merged[int(size)], []
            while need:
                while not left[down[at]]:
                    at += 1
                take = min(need, left[down[at]])
                own.append([down[at], take])
                left[down[at]] -= take
                need -= take
            stock.append(own)
        for pattern, times in configurations(sizes, demand, capacity):
            members = [k for k in range(len(sizes)) for _ in range(int(pattern[k]))]
            want = int(times + 1e-9)
            while want:
                have = [sum(n for _, n in stock[k]) // members.count(k) for k in set(members)]
                if not min(have):
                    break
                # As many sequences as have equal lengths in every slot.
                heads = [stock[k][0] for k in members]
                share = {id(h): sum(h is o for o in heads) for h in heads}
                step = min([want, min(have)] + [h[1] // share[id(h)] for h in heads])
                if not step:                      # a length runs out within one sequence
                    step, slots = 1, []
                    for k in members:
                        slots.append(stock[k][0][0])
                        stock[k][0][1] -= 1
                        if not stock[k][0][1]:
                            stock[k].pop(0)
                else:
                    slots = [h[0] for h in heads]
                    for h in heads:
                        h[1] -= step
                    for k in set(members):
                        stock[k] = [h for h in stock[k] if h[1]]
                run = Run(step, capacity - sum(slots))
                for size in slots:
                    run.slots.append((size, used[size]))
                    used[size] += step
                gaps.add(run)
                want -= step
    for size in map(int, lengths[::-1]):          # what is left, longest first, each where it fits best
        rest = total[size] - used[size]
        while rest:
            run = gaps.tightest(size)
            if run is None:
                each = capacity // size
                many = rest // each
                if many:
                    run = Run(many, capacity - each * size, [(size, used[size] + k * many) for k in range(each)])
                    used[size] += each * many
                    rest -= each * many
                else:
                    run = Run(1, capacity - rest * size, [(size, used[size] + k) for k in range(rest)])
                    used[size] += rest
                    rest = 0
                gaps.add(run)
                continue
            if run.count > rest:
                part = run.split(rest)
                gaps.add(run)
                run = part
            run.slots.append((size, used[size]))
            used[size] += run.count
            rest -= run.count
            run.left -= size
            gaps.add(run)
    return [r for runs in gaps.runs.values() for r in runs]
