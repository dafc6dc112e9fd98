"""Exact k-nearest neighbours and local outlier factor (Breunig et al. 2000) without a cross join.

Identical rows become one weighted point, so no group of copies can grow. The points are cut into boxes by splits
learnt on samples, again and again until no box holds more points than wanted. Each point finds its k nearest inside its own box, which bounds how far the
true neighbours can be, and then asks only the other boxes whose points begin within that distance. Boxes with many points or questions
are split into several groups. Inside a box, small leaves with the extremes of their points spare most distances, and one matrix product bounds most of
the others. Points that ask no box are done without a shuffle. Densities and factors are means over neighbours that are found again by the
known distance of the farthest, so that no lists of neighbours are stored or joined.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabsift.dataset import cut_lineage, steps_of

# Ship this module's functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a box at most about, so many that most points find all neighbours in their own; those of a box are searched in groups, about
#: ``GROUPS`` in all, of ``FEWEST_POINTS`` at least.
FEWEST_POINTS, MOST_POINTS, GROUPS = 2_000, 100_000, 48
LOCAL_POINTS = 64
SAMPLE_POINTS = 200_000
QUESTIONS_PER_GROUP = 20_000


def weighted_points(matrix: DataFrame, columns: list[str], store=cut_lineage) -> DataFrame:
    """(pid, weight, x0, x1, ...): distinct points with their number of rows. Numbers follow the order of the coordinates, so that ties
    between neighbours are broken alike however the points are partitioned."""
    names = [f"x{i}" for i in range(len(columns))]
    points = matrix.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(columns, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("weight"))
    return store(points.orderBy(*names).withColumn("pid", F.monotonically_increasing_id()))


def learn_splits(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """A balanced k-d tree over the sample: axis, cut, children (or leaf number) per node."""
    axis, cut, left, right, leaf = [0], [0.0], [-1], [-1], [-1]
    stack, n_leaves = [(np.arange(len(sample)), max(1, leaves), 0)], 0
    while stack:
        rows, wanted, node = stack.pop()
        part = sample[rows]
        done = wanted <= 1 or len(rows) < 2
        if not done:
            some = np.sort(part[::max(1, len(part) // 256)], axis=0)
            edge = len(some) // 20                       # a few far points don't choose the axis
            width = part.max(axis=0) - part.min(axis=0)
            order = np.lexsort((-width, -(some[len(some) - 1 - edge] - some[edge])))
            for a in order:
                values = np.sort(part[:, a])
                c = float(values[(len(values) - 1) // 2])
                if c >= values[-1]:
                    smaller = values[values < values[-1]]
                    if smaller.size == 0:
                        continue
                    c = float(smaller[-1])
                break
            else:
                done = True
        if done:
            leaf[node] = n_leaves
            n_leaves += 1
            continue
        inside = part[:, a] <= c
        axis[node], cut[node] = int(a), c
        for child_rows, share, side in ((rows[inside], (wanted + 1) // 2, left), (rows[~inside], wanted // 2, right)):
            side[node] = len(axis)
            for column, value in ((axis, 0), (cut, 0.0), (left, -1), (right, -1), (leaf, -1)):
                column.append(value)
            stack.append((child_rows, share, side[node]))
    return {"axis": np.array(axis), "cut": np.array(cut), "left": np.array(left), "right": np.array(right),
            "leaf": np.array(leaf), "n": np.array([n_leaves])}


def assign(tree: dict, x: np.ndarray) -> np.ndarray:
    """The box of each point."""
    node = np.zeros(len(x), dtype=int)
    while True:
        inner = tree["leaf"][node] < 0
        if not inner.any():
            return tree["leaf"][node]
        at = node[inner]
        goes_left = x[inner, tree["axis"][at]] <= tree["cut"][at]
        node[inner] = np.where(goes_left, tree["left"][at], tree["right"][at])


def boxes_within(tree: dict, x: np.ndarray, radius: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) pairs of all boxes other than ``home`` that come within each point's radius."""
    rows_out, boxes_out = [], []
    start = np.arange(len(x))
    stack = [(0, start, np.zeros(x.shape))]       # per-axis distance from the point to the node's region
    while stack:
        node, rows, gap = stack.pop()
        box = tree["leaf"][node]
        if box >= 0:
            if box != home:
                rows_out.append(rows)
                boxes_out.append(np.full(len(rows), box))
            continue
        a, c = tree["axis"][node], tree["cut"][node]
        offset = x[rows, a] - c
        for child, distance in ((tree["left"][node], np.maximum(offset, 0.0)), (tree["right"][node], np.maximum(-offset, 0.0))):
            wider = gap.copy()
            wider[:, a] = np.maximum(wider[:, a], distance)
            near = np.sqrt((wider ** 2).sum(axis=1)) <= radius[rows] * (1 + 1e-12)
            if near.any():
                stack.append((child, rows[near], wider[near]))
    if not rows_out:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(rows_out), np.concatenate(boxes_out)


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all of ``x`` to all ``points``."""
    d = np.zeros((len(x), len(points)))
    for axis in range(points.shape[1]):
        d += (x[:, axis, None] - points[None, :, axis]) ** 2
    return d


def approximate_squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances from one matrix product, each below its true value by a little more than rounding may add."""
    return left @ right.T


def square_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances to the boxes between ``low`` and ``high`` (broadcast over leading axes), never above that to a point inside."""
    total = 0.0
    for axis in range(x.shape[-1]):
        total = total + np.maximum(np.maximum(low[..., axis] - x[..., axis], x[..., axis] - high[..., axis]), 0.0) ** 2
    return total


def box_gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of one box to each of many."""
    return (np.maximum(np.maximum(lows - high, low - highs), 0.0) ** 2).sum(axis=1)


class Leaves:
    """Points in leaves of about ``LOCAL_POINTS``, with the extremes of each leaf. They come sorted by pid and stay so inside a leaf.

    Most distances are only bounded from below, by one matrix product per block of queries; those that may count are measured axis by axis, so that two
    points are equally far apart wherever they meet.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray, leaf: np.ndarray | None = None):
        self.leaf = assign(learn_splits(points, -(-len(points) // LOCAL_POINTS)), points) if leaf is None else leaf
        self.order = np.argsort(self.leaf, kind="stable")
        self.x, self.ids, self.weights = points[self.order], ids[self.order], weights[self.order]
        self.start = np.flatnonzero(np.diff(self.leaf[self.order], prepend=-1))
        self.end = np.append(self.start[1:], len(points))
        self.low, self.high = np.minimum.reduceat(self.x, self.start), np.maximum.reduceat(self.x, self.start)
        self.centre, self.slack = self.x.mean(axis=0), 1e-14 * (2 + points.shape[1])       # many times the rounding error of a product
        self.norm, self.right = self._factor(self.x, -2.0)
        self.by_id = np.argsort(self.ids)

    def _factor(self, x: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
        c = x - self.centre
        norm = (c ** 2).sum(axis=1)
        less, one = norm * (1 - self.slack), np.ones(len(x))
        return norm, np.column_stack([sign * c, one, less] if sign < 0 else [sign * c, less, one])

    def places(self, leaves: np.ndarray) -> np.ndarray:
        """Places of the points of these leaves."""
        size = self.end[leaves] - self.start[leaves]
        return np.repeat(self.start[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def place_of(self, ids: np.ndarray) -> np.ndarray:
        """Where these points are, or -1."""
        at = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)]
        return np.where(self.ids[at] == ids, at, -1)

    def bound(self, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Squares within which each query surely has ``k`` points other than that at ``own``, from the leaves around all of them."""
        gap = box_gaps(x.min(axis=0), x.max(axis=0), self.low, self.high)
        off = (((self.low + self.high) / 2 - x.mean(axis=0)) ** 2).sum(axis=1)
        at = np.sort(self.places(np.lexsort((off, gap))[:2 + x.shape[1]]))
        if len(at) <= k:
            return np.full(len(x), np.inf)
        norm, left = self._factor(x, 1.0)
        d = approximate_squares(left, self.right[at])
        hit = np.searchsorted(at, own)
        inside = np.flatnonzero((own >= 0) & (at[np.minimum(hit, len(at) - 1)] == own))
        d[inside, hit[inside]] = np.inf
        d = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * self.slack * (norm + self.norm[at].max())
        return np.where(np.isfinite(d), np.maximum(d, 0.0) * (1 + 1e-15), np.inf)

    def within(self, x: np.ndarray, bound: np.ndarray, own: np.ndarray):
        """(query row, place, squared distance) of all points within each query's bound, other than that at ``own``."""
        bound = np.minimum(bound, np.finfo(float).max)
        _, left = self._factor(x, 1.0)
        rows, cols, found = [], [], []
        leaves = np.flatnonzero(box_gaps(x.min(axis=0), x.max(axis=0), self.low, self.high) <= bound.max())
        # Queries that reach about as far need about the same leaves.
        for few in np.array_split(np.argsort(bound, kind="stable"), 4 if len(leaves) > LOCAL_POINTS and len(x) >= 16 else 1):
            reach, q = bound[few, None], x[few]
            near = leaves[box_gaps(q.min(axis=0), q.max(axis=0), self.low[leaves], self.high[leaves]) <= reach.max()]
            some = [part[(square_gaps(q[:, None, :], self.low[part][None], self.high[part][None]) <= reach).any(axis=0)]
                    for part in np.split(near, range(1_024, len(near), 1_024))]
            at = self.places(np.concatenate(some))
            for part in np.split(at, range(8_192, len(at), 8_192)):
                d = approximate_squares(left[few], self.right[part])
                row, col = np.divmod(np.flatnonzero(~(d > reach)), len(part))        # what overflows is measured, too
                row, col = few[row], part[col]
                square = np.zeros(len(row))
                for axis in range(x.shape[1]):
                    square += (x[row, axis] - self.x[col, axis]) ** 2
                inside = (square <= bound[row]) & (col != own[row])
                rows.append(row[inside])
                cols.append(col[inside])
                found.append(square[inside])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(found)

    def blocks(self, first: int = 0, step: int = 1) -> list[np.ndarray]:
        """Places of the points leaf by leaf, of every ``step``-th leaf."""
        return [np.arange(self.start[j], self.end[j]) for j in range(first, len(self.start), step)]


def query_blocks(x: np.ndarray) -> list[np.ndarray]:
    """Rows of queries that lie close together."""
    leaf = assign(learn_splits(x, -(-len(x) // LOCAL_POINTS)), x)
    order = np.argsort(leaf, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)


def nearest_in(leaves: Leaves, x: np.ndarray, ids: np.ndarray, k: int, radius: np.ndarray | None):
    """(query row, distance, place, weight) of at most ``k`` points per query, nearest first; ties go to the smaller pid.

    Without a radius the nearest are found, else those within it. A point's own copies count as neighbours at distance 0.
    """
    at = leaves.place_of(ids)
    own = np.where((at >= 0) & (leaves.weights[at] <= 1), at, -1)
    bound = leaves.bound(x, own, k) if radius is None else radius ** 2 * (1 + 1e-9)         # slightly wide; the merge keeps the k nearest
    row, col, square = leaves.within(x, bound, own)
    distance = np.sqrt(square)
    order = np.lexsort((leaves.ids[col], distance, row))
    row, col, distance = row[order], col[order], distance[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, distance = row[place < k], col[place < k], distance[place < k]
    return row, distance, col, leaves.weights[col] - (at[row] == col)


def nearest_pairs(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, weights: np.ndarray,
                  k: int, radius: np.ndarray | None):
    """Flat (query row, distance, pid, weight), nearest first per query, over points that come sorted by pid."""
    leaves, out = Leaves(points, ids, weights), []
    for block in query_blocks(queries):
        row, distance, col, count = nearest_in(leaves, queries[block], query_ids[block], k, None if radius is None else radius[block])
        out.append((block[row], distance, leaves.ids[col], count))
    flat = [np.concatenate(part) for part in zip(*out)]
    order = np.argsort(flat[0], kind="stable")
    return [part[order] for part in flat]


CANDIDATES = "array<struct<distance:double,weight:long>>"
TIES = "array<struct<pid:long,weight:long,value:double>>"


def lists(rows: int, row: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """One list of structs per query row, built from flat arrays that are sorted by row."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def coordinates(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in columns]).reshape(len(table), len(columns))


def grafted(tree: dict, subtrees: dict[int, dict]) -> dict:
    """The tree with some of its leaves replaced by trees of their own; leaves are numbered anew."""
    parts = {k: [tree[k]] for k in ("axis", "cut", "left", "right", "leaf")}
    size, leaves = len(tree["leaf"]), int(tree["n"][0])
    top = {k: tree[k].copy() for k in parts}
    for box, sub in subtrees.items():
        node = int(np.flatnonzero(tree["leaf"] == box)[0])
        move = lambda v: np.where(v >= 0, v - 1 + size, -1)  # noqa: E731  a root's children follow it, and the root takes the leaf's place
        top["axis"][node], top["cut"][node], top["leaf"][node] = sub["axis"][0], sub["cut"][0], -1
        top["left"][node], top["right"][node] = move(sub["left"][:1])[0], move(sub["right"][:1])[0]
        parts["axis"].append(sub["axis"][1:])
        parts["cut"].append(sub["cut"][1:])
        parts["left"].append(move(sub["left"][1:]))
        parts["right"].append(move(sub["right"][1:]))
        parts["leaf"].append(np.where(sub["leaf"][1:] >= 0, sub["leaf"][1:] + leaves, -1))
        size += len(sub["leaf"]) - 1
        leaves += int(sub["n"][0])
    out = {k: np.concatenate([top[k], *parts[k][1:]]) for k in parts}
    own = out["leaf"] >= 0
    out["leaf"][own] = np.arange(int(own.sum()))
    return out | {"n": np.array([int(own.sum())])}


def boxes(points: DataFrame, columns: list[str], leaf_points: int, sample_points: int, store=cut_lineage) -> tuple[dict, DataFrame]:
    """The tree, and the points with their box; every box holds at most twice ``leaf_points`` points.

    Each round samples the boxes that hold more, by hash, about ``sample_points`` points in all, and splits them by that sample.
    """
    spark = points.sparkSession
    schema = ", ".join(f"`{c}` double" for c in columns)
    tree = learn_splits(np.empty((0, len(columns))), 1)
    turn = 0
    while True:
        shared = spark.sparkContext.broadcast(tree)

        def place(batches, shared=shared):
            for batch in batches:
                yield batch.assign(box=assign(shared.value, batch[columns].to_numpy(dtype="float64")))

        placed = points.select("pid", "weight", *columns).mapInPandas(place, f"pid long, weight long, {schema}, box int")
        full = placed.groupBy("box").count().where(F.col("count") > 2 * leaf_points)
        large = {r["box"]: r["count"] for r in full.collect()}          # one row per box that is still too large
        if not large:
            return tree, store(placed)
        share = min(1.0, sample_points / sum(large.values()))
        draw = F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(1 << 53)) / float(1 << 53)
        picked = placed.join(full.select("box"), "box", "left_semi").where(draw < share)
        sample = picked.orderBy("box", "pid").select("box", *columns).toPandas()
        subtrees = {}
        for box, rows in sample.groupby("box"):
            x = rows[columns].to_numpy(dtype="float64")
            sub = learn_splits(x, min(max(2, round(large[box] / leaf_points)), max(2, len(x) // 4)))
            if int(sub["n"][0]) > 1:
                subtrees[int(box)] = sub
        tree, turn = grafted(tree, subtrees), turn + 1


def extremes(placed: DataFrame, columns: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of the points of each box; one row per box is collected."""
    low, high = np.full((n, len(columns)), np.inf), np.full((n, len(columns)), -np.inf)
    ends = [f(c).alias(f"{e}{i}") for i, c in enumerate(columns) for e, f in (("low", F.min), ("high", F.max))]
    for r in placed.groupBy("box").agg(*ends).collect():
        low[r["box"]], high[r["box"]] = ([r[f"{e}{i}"] for i in range(len(columns))] for e in ("low", "high"))
    return low, high


def asked_boxes(shared: dict, x: np.ndarray, radius: np.ndarray, home: int) -> pa.Array:
    """Per point the other boxes whose points begin within its radius."""
    asker, box = boxes_within(shared, x, radius, home)
    low, high = shared["ends"]
    near = np.sqrt(square_gaps(x[asker], low[box], high[box])) <= radius[asker] * (1 + 1e-12)
    asker, box = asker[near], box[near]
    order = np.argsort(asker, kind="stable")
    offsets = np.searchsorted(asker[order], np.arange(len(x) + 1)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(box[order].astype("int32")))


def partial_means(leaves: Leaves, x: np.ndarray, ids: np.ndarray, radius: np.ndarray, k: int, value) -> tuple:
    """What one box has of each query's neighbours, which lie within its k-distance: the sum of weight times value and the weight of those
    nearer than that, and (query row, pid, weight, value) of those just there, by pid, as only the first of them may belong to the k.

    ``value(place, distance)`` answers for neighbours.
    """
    at = leaves.place_of(ids)
    own = np.where((at >= 0) & (leaves.weights[at] <= 1), at, -1)
    row, col, square = leaves.within(x, radius ** 2 * (1 + 1e-9), own)
    distance = np.sqrt(square)
    weight, worth = leaves.weights[col] - (at[row] == col), value(col, distance)
    inner, tie = distance < radius[row], np.flatnonzero(distance == radius[row])
    total = np.bincount(row[inner], weights=(weight * worth)[inner], minlength=len(x))
    count = np.bincount(row[inner], weights=weight[inner], minlength=len(x)).astype("int64")
    tie = tie[np.lexsort((leaves.ids[col[tie]], row[tie]))]
    place = np.arange(len(tie)) - np.searchsorted(row[tie], row[tie])
    tie = tie[place < k]
    return total, count, row[tie], leaves.ids[col[tie]], weight[tie], worth[tie]


class Search:
    """The points in their boxes, and steps over all neighbours of each point.

    A step first does for each point what its own box can tell. Points that reach into other boxes ask these, by a shuffle of such
    points alone; the answers are merged with what their own box had. No neighbour lists are kept.
    """

    def __init__(self, points: DataFrame, columns: list[str], k: int, leaf_points: int | None = None, questions: int = QUESTIONS_PER_GROUP,
                 sample_points: int = SAMPLE_POINTS, store=cut_lineage):
        self.columns, self.k, self.questions, self.spark = columns, k, questions, points.sparkSession
        self.schema = ", ".join(f"`{c}` double" for c in columns)
        self.tree, self.placed = boxes(points, columns, leaf_points or MOST_POINTS, sample_points, store)
        sizes = {r["box"]: r["count"] for r in self.placed.groupBy("box").count().collect()}         # one row per box
        group = max(FEWEST_POINTS, sum(sizes.values()) // GROUPS)
        self.parts = {b: -(-n // group) for b, n in sizes.items()}
        self.shared = self.spark.sparkContext.broadcast({**self.tree, "ends": extremes(self.placed, columns, int(self.tree["n"][0]))})

    def inside(self, table: DataFrame, work, schema: str) -> DataFrame:
        """``work(group, first, step)`` over each box, of which large ones go to several tasks that take every ``step``-th leaf."""
        several = {b: n for b, n in self.parts.items() if n > 1}
        steps = F.lit(1)
        if several:
            found = self.spark.createDataFrame(list(several.items()), "box int, step int")
            table = table.join(F.broadcast(found), "box", "left")
            steps = F.coalesce("step", F.lit(1))
        table = table.withColumn("step", steps).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("step") - 1)))

        def each(group: pa.Table) -> pa.Table:
            group = group.sort_by("pid")
            return work(group, group.column("part")[0].as_py(), group.column("step")[0].as_py())

        # A box is little data and much work, so its tasks are not left to be joined by size.
        return table.repartition(self._tasks(sum(self.parts.values())), "box", "part").groupBy("box", "part").applyInArrow(each, schema)

    def _tasks(self, groups: int) -> int:
        return max(1, min(groups, max(4 * self.spark.sparkContext.defaultParallelism, groups // 4)))

    def outside(self, own: DataFrame, data: DataFrame, radius: str, work, schema: str) -> DataFrame:
        """``work(questions, points)`` over each box and the points of other boxes that ask it; busy boxes go to several tasks."""
        asked = own.where(F.size("ask") > 0).select("pid", *self.columns, radius, F.explode("ask").alias("box"))
        load = asked.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / self.questions).cast("int").alias("parts"))
        parts = {r["box"]: r["parts"] for r in load.collect()}                                      # one row per box that is asked
        if not parts:
            return self.spark.createDataFrame([], schema)
        load = F.broadcast(self.spark.createDataFrame(list(parts.items()), "box int, parts int"))
        queries = asked.join(load, "box").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")).drop("parts")
        data = data.toDF(*data.columns).join(load, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys, tasks = ("box", "part"), self._tasks(sum(parts.values()))
        nothing = to_arrow_schema(self.spark.createDataFrame([], schema).schema).empty_table()

        def each(q: pa.Table, p: pa.Table) -> pa.Table:
            return work(q, p.sort_by("pid")) if len(q) and len(p) else nothing

        return queries.repartition(tasks, *keys).groupBy(*keys).cogroup(data.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(each, schema)

    def k_distances(self, store) -> DataFrame:
        """The points with their box, their leaf inside it and the distance at which the weights of their nearest neighbours reach k."""
        columns, k, shared = self.columns, self.k, self.shared

        def search(group: pa.Table, first: int, step: int) -> pa.Table:
            leaves, home = leaves_of(group, columns), group.column("box")[0].as_py()
            mine = leaves.blocks(first, step)
            found = [nearest_in(leaves, leaves.x[b], leaves.ids[b], k, None) for b in mine]
            begin = np.cumsum([0, *map(len, mine)])
            at = np.concatenate(mine) if mine else np.empty(0, int)
            row, distance, count = ([np.concatenate([np.empty(0, t), *part]) for part, t in
                                     zip(([f[0] + s for f, s in zip(found, begin)], [f[1] for f in found], [f[3] for f in found]), (int, float, int))])
            running = within_rows(row, count)
            needed, reached = running - count < k, (running >= k) & (running - count < k)
            radius, last = np.full(len(at), np.inf), np.full(len(at), np.nan)
            radius[row[reached]] = distance[reached]
            last[row] = distance                                 # rows come nearest first, so the farthest stays
            ask = asked_boxes(shared.value, leaves.x[at], radius, home)
            kept = needed & (pc.list_value_length(ask).to_numpy(zero_copy_only=False) > 0)[row]
            own = group.take(leaves.order[at])
            return pa.Table.from_arrays(
                [*[own.column(c) for c in ("pid", "weight", *columns, "box")], pa.array(leaves.leaf[leaves.order[at]].astype("int32")), pa.array(radius),
                 pa.array(np.where(np.isfinite(radius), radius, last), from_pandas=True), lists(len(at), row[kept], distance=distance[kept], weight=count[kept]), ask],
                names=["pid", "weight", *columns, "box", "leaf", "radius", "k_distance", "candidates", "ask"])

        def answer(q: pa.Table, p: pa.Table) -> pa.Table:
            leaves, x, ids, radius = leaves_of(p, columns), coordinates(q, columns), q.column("pid").to_numpy(), q.column("radius").to_numpy()
            blocks = query_blocks(x)
            found = [nearest_in(leaves, x[b], ids[b], k, radius[b]) for b in blocks]
            row, distance, count = (np.concatenate([f[i] if i else f[i] + s for f, s in zip(found, np.cumsum([0, *map(len, blocks)]))]) for i in (0, 1, 3))
            return pa.Table.from_arrays([pa.array(ids[np.concatenate(blocks)]), lists(len(x), row, distance=distance, weight=count)], names=["pid", "candidates"])

        state = f"pid long, weight long, {self.schema}, box int, leaf int"
        own = store(self.inside(self.placed, search, f"{state}, radius double, k_distance double, candidates {CANDIDATES}, ask array<int>"))
        names = ["pid", "weight", *columns, "box", "leaf"]
        foreign = (self.outside(own, own.select(*names), "radius", answer, f"pid long, candidates {CANDIDATES}").where(F.size("candidates") > 0)
                   .groupBy("pid").agg(F.flatten(F.collect_list("candidates")).alias("more")))
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast("double").alias("distance"))
        nearest = F.sort_array(F.concat("candidates", F.coalesce("more", F.array().cast(CANDIDATES))))
        last = F.aggregate(F.slice(nearest, 1, k), start, lambda acc, c: F.when(acc["used"] < k, F.struct(
            (acc["used"] + c["weight"]).alias("used"), c["distance"].alias("distance"))).otherwise(acc))["distance"]
        asking = own.where(F.size("ask") > 0).join(foreign, "pid", "left").select(*names, last.alias("k_distance"))
        return own.where(F.size("ask") == 0).select(*names, "k_distance").unionByName(asking).withColumn(
            "k_distance", F.coalesce("k_distance", F.raise_error(F.lit("a point without neighbours, or with a coordinate missing")).cast("double")))

    def neighbour_means(self, table: DataFrame, value, store) -> DataFrame:
        """The rows of ``table`` with the mean over the k nearest neighbours of ``value(column of the neighbours, distance)``, which answers with an array."""
        columns, k, shared, given = self.columns, self.k, self.shared, table.columns

        def of(p: pa.Table):
            leaves = leaves_of(p, columns)
            held = {c: p.column(c).to_numpy()[leaves.order] for c in given if c not in columns}
            return leaves, held, lambda col, distance: value({c: v[col] for c, v in held.items()}, distance)

        def search(group: pa.Table, first: int, step: int) -> pa.Table:
            leaves, held, worth = of(group)
            mine, home = leaves.blocks(first, step), group.column("box")[0].as_py()
            at = np.concatenate(mine) if mine else np.empty(0, int)
            total, count, row, pid, weight, tied = joined([partial_means(leaves, leaves.x[b], leaves.ids[b], held["k_distance"][b], k, worth) for b in mine])
            ask = asked_boxes(shared.value, leaves.x[at], held["k_distance"][at], home)
            alone = (pc.list_value_length(ask).to_numpy(zero_copy_only=False) == 0)
            share = np.clip(k - count[row] - (within_rows(row, weight) - weight), 0, weight) * alone[row]
            total = total + np.bincount(row, weights=share * tied, minlength=len(at))
            count = count + np.bincount(row, weights=share, minlength=len(at)).astype("int64")
            kept = ~alone[row]
            own = group.take(leaves.order[at])
            return pa.Table.from_arrays([*[own.column(c) for c in given], pa.array(total), pa.array(count),
                                         lists(len(at), row[kept], pid=pid[kept], weight=weight[kept], value=tied[kept]), ask], names=[*given, "total", "count", "ties", "ask"])

        def answer(q: pa.Table, p: pa.Table) -> pa.Table:
            leaves, _, worth = of(p)
            x, ids, radius = coordinates(q, columns), q.column("pid").to_numpy(), q.column("k_distance").to_numpy()
            blocks = query_blocks(x)
            total, count, row, pid, weight, tied = joined([partial_means(leaves, x[b], ids[b], radius[b], k, worth) for b in blocks])
            return pa.Table.from_arrays([pa.array(ids[np.concatenate(blocks)]), pa.array(total), pa.array(count), lists(len(x), row, pid=pid, weight=weight, value=tied)],
                                        names=["pid", "total", "count", "ties"])

        part = f"total double, count long, ties {TIES}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        own = store(self.inside(table, search, f"{schema}, {part}, ask array<int>"))
        foreign = (self.outside(own, table, "k_distance", answer, f"pid long, {part}").where((F.col("count") > 0) | (F.size("ties") > 0)).groupBy("pid")
                   .agg(F.sum("total").alias("more_total"), F.sum("count").alias("more_count"), F.flatten(F.collect_list("ties")).alias("more")))
        # Of those at the k-distance as many count as are wanted, the last one perhaps in part.
        start = F.struct((F.col("count") + F.coalesce("more_count", F.lit(0))).alias("used"), (F.col("total") + F.coalesce("more_total", F.lit(0.0))).alias("total"))

        def take(acc, c):
            share = F.least(F.lit(k).cast("long") - acc["used"], c["weight"])
            return F.struct((acc["used"] + share).alias("used"), (acc["total"] + share * c["value"]).alias("total"))

        taken = F.aggregate(F.sort_array(F.concat("ties", F.coalesce("more", F.array().cast(TIES)))), start, take)
        asking = own.where(F.size("ask") > 0).join(foreign, "pid", "left").select(*given, taken.alias("taken")).select(*given, (F.col("taken.total") / F.col("taken.used")).alias("mean"))
        return own.where(F.size("ask") == 0).select(*given, (F.col("total") / F.col("count")).alias("mean")).unionByName(asking)


def leaves_of(group: pa.Table, columns: list[str]) -> Leaves:
    """Points sorted by pid, in the leaves that they have been given if they have."""
    leaf = group.column("leaf").to_numpy() if "leaf" in group.column_names else None
    return Leaves(coordinates(group, columns), group.column("pid").to_numpy(), group.column("weight").to_numpy(), leaf)


def within_rows(row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Running sums of the counts of each row; rows come in turn."""
    total, first = np.cumsum(count), np.searchsorted(row, row)
    return total - total[first] + count[first]


def joined(parts: list[tuple]) -> tuple:
    """Results of :func:`partial_means` for several blocks as one; rows are numbered on."""
    begin = np.cumsum([0, *[len(p[0]) for p in parts]])
    kinds = (float, "int64", "int64", "int64", "int64", float)
    return tuple(np.concatenate([np.empty(0, kind), *[p[i] + s if i == 2 else p[i] for p, s in zip(parts, begin)]]).astype(kind) for i, kind in enumerate(kinds))


def local_outlier_factor(matrix: DataFrame, columns: list[str], k: int, keep=cut_lineage, **options) -> DataFrame:
    """(*columns, lof) for every distinct point of the matrix. Only these rows stay on the shared storage, where ``keep`` puts them."""
    spark, names = matrix.sparkSession, [f"x{i}" for i in range(len(columns))]
    with steps_of(spark) as last:
        with steps_of(spark) as first:
            with steps_of(spark) as second:
                search = Search(weighted_points(matrix, columns, second), names, k, store=first, **options)
            with steps_of(spark) as second:
                reach = last(search.k_distances(second))
        with steps_of(spark) as second:
            means = search.neighbour_means(reach, lambda their, distance: np.maximum(their["k_distance"], distance), second)
            density = last(means.withColumn("density", 1.0 / (F.col("mean") + 1e-10)).drop("mean"))
        with steps_of(spark) as second:
            around = search.neighbour_means(density, lambda their, distance: their["density"], second)
            return keep(around.select(*[F.col(x).alias(c) for c, x in zip(columns, names)], (F.col("mean") / F.col("density")).alias("lof")))
