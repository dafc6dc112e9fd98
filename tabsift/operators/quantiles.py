"""Exact interpolated quantiles in two or three scans, which never gather a column in one place.

A small table is one plain aggregation. Else the first scan makes a KLL sketch of every column. Its rank error brackets each wanted order statistic between two values of the column. The
second scan counts what lies below and on the bracket's ends and keeps the few values strictly inside. Where these would be too many, it
sketches them instead, and a third scan keeps the values inside the bracket that this sketch gives, about a hundredth of the first one. Ranks that a sketch has
missed are bracketed again inside the part that holds them, in rounds of constant state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 2_000
#: Items per level of a sketch, and the share of ranks by which its answers may be off: twice the library's published error.
SKETCH, ERROR = 4_096, 2 * 2.296 / 4_096 ** 0.9021
#: At most this many values, of all brackets together, are kept by the second scan and go to the driver.
KEPT = 500_000
#: Tables of at most so many rows are one aggregation.
FEW = 25_000
#: Among so few values all are kept; among more, a sketch's error spans more than two ranks.
SMALL = 2_000
#: Scans that may narrow brackets before what is left goes to rounds; two are enough for 10 billion rows.
TURNS = 4
#: Even steps of ranks that are asked of such a bracket's sketch.
GRID = 400


@dataclass
class Bracket:
    """Values around one wanted quantile: what the second scan has to count and keep."""

    column: int
    low: float
    high: float
    ranks: tuple[int, ...]
    expected: float

    def kept(self, room: float) -> bool:
        return self.expected <= room or self.high <= self.low

    def aggregates(self, j: int, room: float) -> list[Column]:
        x = F.col(f"x{self.column}")
        inside = (x > self.low) & (x < self.high)
        out = [F.count_if(x < self.low).alias(f"below{j}"), F.count_if(x == self.low).alias(f"low{j}"), F.count_if(x == self.high).alias(f"high{j}")]
        if not self.kept(room):
            return [*out, F.count_if(inside).alias(f"n{j}"), F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH)).alias(f"s{j}")]
        return out + ([F.collect_list(F.when(inside, x)).alias(f"inside{j}")] if self.high > self.low else [])

    def edges(self, j: int) -> Column:
        """Values at even ranks of the sketch of what lies inside; a sketch takes only ranks that are known beforehand."""
        ranks = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
        return F.when(F.col(f"n{j}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{j}"), ranks)).alias(f"e{j}")

    def narrowed(self, row, j: int) -> Bracket | None:
        """The bracket of the ranks that lie inside, if any do."""
        first, n = row[f"below{j}"] + row[f"low{j}"], row[f"n{j}"]
        ranks = tuple(r for r in self.ranks if first <= r < first + n)
        if not ranks:
            return None
        low = max(0, math.floor(((ranks[0] - first) / n - ERROR) * GRID))
        high = min(GRID, math.ceil(((ranks[-1] + 1 - first) / n + ERROR) * GRID))
        return Bracket(self.column, row[f"e{j}"][low], row[f"e{j}"][high], ranks, (high - low) / GRID * n)

    def end(self, row, j: int, rank: int) -> float | None:
        """The value at a rank that is one of the bracket's ends."""
        k = rank - row[f"below{j}"]
        if 0 <= k < row[f"low{j}"]:
            return self.low
        return self.high if 0 <= k - row[f"low{j}"] - row[f"n{j}"] < row[f"high{j}"] else None

    def answer(self, row, j: int, rank: int) -> float | None:
        """The value at a rank, or None if it lies outside, which has to be looked for in another way."""
        k = rank - row[f"below{j}"]
        inside = sorted(row.get(f"inside{j}", []))
        if k < 0:
            return None
        if k < row[f"low{j}"]:
            return self.low
        k -= row[f"low{j}"]
        if k < len(inside):
            return inside[k]
        return self.high if k - len(inside) < (row[f"high{j}"] if self.high > self.low else 0) else None


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], accuracy: int = ACCURACY, kept: int = KEPT) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each expression; NULL and NaN are ignored."""
    return quantile_groups(df, {n: (c, shares) for n, c in columns.items()}, accuracy, kept)


def quantile_groups(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], accuracy: int = ACCURACY, kept: int = KEPT) -> dict[str, list[float | None]]:
    """Like :func:`exact_quantiles`, with shares of each column's own; all columns share the two scans."""
    names = list(wanted)
    if not names:
        return {}

    def number(c: Column) -> Column:
        x = c.cast("double")
        return F.when(~F.isnan(x), x)

    values = df.select(*[number(wanted[n][0]).alias(f"x{i}") for i, n in enumerate(names)])
    if kept >= FEW and len(df.select(F.lit(1)).take(FEW + 1)) <= FEW:       # so few rows that their values may lie in one hash map; a large table is only begun
        row = values.agg(*[F.percentile(f"x{i}", F.array(*[F.lit(float(s)) for s in wanted[n][1]])).alias(f"p{i}") for i, n in enumerate(names)]).first()
        return {n: row[f"p{i}"] or [None] * len(wanted[n][1]) for i, n in enumerate(names)}
    sketched = values.agg(*[a for i in range(len(names)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.min(f"x{i}").alias(f"min{i}"), F.max(f"x{i}").alias(f"max{i}"),
                                                                 F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH)).alias(f"s{i}"))])

    def edges(i: int, shares: list[float]) -> Column:
        asked = [min(1.0, max(0.0, e)) for s in shares for e in (s - ERROR, s + ERROR)]
        return F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.array(*[F.lit(a) for a in asked])))

    row = sketched.select(*[c for i, n in enumerate(names) for c in (f"n{i}", f"min{i}", f"max{i}", edges(i, wanted[n][1]).alias(f"e{i}"))]).first()
    sizes = {i: row[f"n{i}"] for i in range(len(names)) if row[f"n{i}"]}
    brackets: dict[tuple[int, float], Bracket] = {}
    room = kept / max(1, sum(len(wanted[names[i]][1]) for i in sizes))
    for i, size in sizes.items():
        for j, share in enumerate(wanted[names[i]][1]):
            place = (size - 1) * share
            low = row[f"min{i}"] if size <= SMALL or share <= ERROR else row[f"e{i}"][2 * j]
            high = row[f"max{i}"] if size <= SMALL or share + ERROR >= 1 else row[f"e{i}"][2 * j + 1]
            brackets[i, share] = Bracket(i, low, high, (math.floor(place), math.ceil(place)), size if size <= SMALL else 2 * ERROR * size)
    found: dict[tuple[int, int], float] = {}
    open_, turns = list(brackets.values()) if room >= 1 else [], 0
    while open_ and turns < TURNS:
        narrow = [j for j, b in enumerate(open_) if not b.kept(room)]
        counted = values.agg(*[a for j, b in enumerate(open_) for a in b.aggregates(j, room)])
        row = counted.select(*[c for c in counted.columns if not c.startswith("s")], *[open_[j].edges(j) for j in narrow]).first().asDict()
        for j, b in enumerate(open_):
            for rank in b.ranks:
                if j in narrow and (value := b.end(row, j, rank)) is not None or j not in narrow and (value := b.answer(row, j, rank)) is not None:
                    found[b.column, rank] = value
        open_, turns = [b for j in narrow if (b := open_[j].narrowed(row, j)) is not None], turns + 1
    every = {(i, r) for i, n in sizes.items() for s in wanted[names[i]][1] for r in (math.floor((n - 1) * s), math.ceil((n - 1) * s))}
    left = sorted(every - set(found))
    found.update(order_statistics(values, sizes, left, accuracy) if left else {})

    def interpolated(i: int, share: float) -> float:
        place = (sizes[i] - 1) * share
        low, high = found[i, math.floor(place)], found[i, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return {n: [interpolated(i, s) if i in sizes else None for s in wanted[n][1]] for i, n in enumerate(names)}


@dataclass
class Search:
    """The interval of column ``x{i}`` that still holds the value at 0-based ``rank``."""

    column: int
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    open_low: bool = False
    open_high: bool = False
    answer: float | None = None

    def interval(self) -> tuple:
        return self.column, self.low, self.high, self.open_low, self.open_high

    def shares(self, accuracy: int) -> list[float]:
        """Where to look for pivots: around the rank, or, among so few values that percentiles are exact, right at it."""
        at, slack = (self.rank - self.below + 0.5) / self.inside, 0.0 if self.inside < accuracy // 2 else 2.0 / accuracy
        return [max(0.0, at - slack), min(1.0, at + slack)]

    def condition(self) -> Column:
        x = F.col(f"x{self.column}")
        left = x > self.low if self.open_low else x >= self.low
        right = x < self.high if self.open_high else x <= self.high
        return x.isNotNull() & left & right

    def narrow(self, a: float, b: float, c: dict) -> None:
        """Go on in the part around pivots a <= b that holds the rank; a hit on a pivot is the answer."""
        k, parts = self.rank - self.below, [c["lt"], c["eq_a"], c["mid"], c["eq_b"]]
        edge = [sum(parts[:j + 1]) for j in range(4)]
        if k < edge[0]:
            self.high, self.open_high, self.inside = a, True, parts[0]
        elif k < edge[1]:
            self.answer = a
        elif k < edge[2]:
            self.below, self.inside = self.below + edge[1], parts[2]
            self.low, self.high, self.open_low, self.open_high = a, b, True, True
        elif k < edge[3]:
            self.answer = b
        else:
            self.below, self.inside = self.below + edge[3], self.inside - edge[3]
            self.low, self.open_low = b, True


def order_statistics(values: DataFrame, sizes: dict[int, int], wanted: list[tuple[int, int]], accuracy: int = ACCURACY) -> dict[tuple[int, int], float]:
    """The values at the wanted (column, rank) places.

    All searches share their scans: a round is one aggregation for pivots and one for counts, whatever the number of columns and
    ranks, and leaves about a thousandth of the rows. Searches in one interval share its sketch.
    """
    searches = [Search(i, r, sizes[i]) for i, r in wanted]
    while active := [s for s in searches if s.answer is None]:
        together: dict[tuple, list[Search]] = {}
        for s in active:
            together.setdefault(s.interval(), []).append(s)
        sketches = [F.percentile_approx(F.when(group[0].condition(), F.col(f"x{group[0].column}")), [x for s in group for x in s.shares(accuracy)], accuracy).alias(f"p{j}")
                    for j, group in enumerate(together.values())]
        row = values.agg(*sketches).first()
        pivots = [(s, row[f"p{j}"][2 * k:2 * k + 2]) for j, group in enumerate(together.values()) for k, s in enumerate(group)]
        counts = []
        for j, (s, (a, b)) in enumerate(pivots):
            x, here = F.col(f"x{s.column}"), s.condition()
            tests = {"lt": x < a, "eq_a": x == a, "mid": (x > a) & (x < b), "eq_b": (x == b) & (x > a)}
            counts += [F.count_if(here & t).alias(f"{k}{j}") for k, t in tests.items()]
        row = values.agg(*counts).first()
        for j, (s, (a, b)) in enumerate(pivots):
            s.narrow(a, b, {k: row[f"{k}{j}"] for k in ("lt", "eq_a", "mid", "eq_b")})
    return {(s.column, s.rank): s.answer for s in searches}
