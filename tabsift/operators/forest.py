"""Isolation forest (Liu, Ting and Zhou 2008) trained on a fixed-size pool and scored where the rows are."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabsift.operators.ranking import global_position

# Ship this module's functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n entries."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def training_pool(matrix: DataFrame, row_id: str, columns: list[str], size: int, seed: int) -> np.ndarray:
    """The method's training rows: a uniform sample without replacement, the ``size`` smallest seeded hashes of the row key.

    ``size`` is trees x subsample, as the method fixes it for any number of rows. Only hash buckets that can hold these rows are ranked.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{row_id}`").cast("string")))
    rows = matrix.select(key.alias("key"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)])
    pool = global_position(rows, "key", size).drop("key").toPandas().sort_values("position").drop(columns="position")
    return pool.to_numpy(dtype="float64")


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one random isolation tree as (node, feature, threshold, left, right, path)."""
    nodes: list[tuple] = []
    stack = [(np.arange(len(sample)), 0, 0)]
    used = 1
    while stack:
        rows, depth, node = stack.pop()
        part = sample[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else np.empty(0, int)
        if depth >= limit or spread.size == 0:
            nodes.append((node, -1, 0.0, node, node, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(spread))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        goes_left = part[:, feature] <= threshold
        left, right, used = used, used + 1, used + 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        stack += [(rows[goes_left], depth + 1, left), (rows[~goes_left], depth + 1, right)]
    return nodes


def fit(matrix: DataFrame, row_id: str, columns: list[str], trees: int, subsample: int, seed: int) -> tuple[list[np.ndarray], int]:
    """The forest as flat node arrays; trees grow in parallel tasks from the broadcast pool."""
    spark = matrix.sparkSession
    pool = training_pool(matrix, row_id, columns, trees * subsample, seed)
    size = min(subsample, len(pool))
    shared = spark.sparkContext.broadcast(pool)
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(batches):
        for batch in batches:
            rows = []
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                chosen = shared.value[rng.choice(len(shared.value), size=size, replace=False)]
                rows += [(int(tree), *node) for node in _grow(chosen, rng, limit)]
            yield pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    nodes = spark.range(trees).mapInPandas(grow, TREE).toPandas().sort_values(["tree", "node"])
    width = int(nodes["node"].max()) + 1
    arrays = []
    for name, kind in (("feature", "int32"), ("threshold", "float64"), ("left", "int32"), ("right", "int32"), ("path", "float64")):
        flat = np.zeros((trees, width), dtype=kind)
        if name == "feature":
            flat[:] = -1
        flat[nodes["tree"], nodes["node"]] = nodes[name]
        arrays.append(flat)
    return arrays, size


def score_column(spark, forest: list[np.ndarray], size: int, columns: list[str]) -> Column:
    """Anomaly score in (0, 1]; Arrow batches, no join and no shuffle."""
    shared = spark.sparkContext.broadcast(forest)
    depth = math.ceil(math.log2(max(size, 2)))
    norm = average_path(size) or 1.0

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        feature, threshold, left, right, path = shared.value
        x = np.ascontiguousarray(np.column_stack([v.to_numpy(dtype="float64") for v in values]))
        flat, base, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for t in range(len(feature)):
            leaf = feature[t] < 0                 # a leaf leads back to itself
            axis = np.where(leaf, 0, feature[t]).astype(np.intp)
            child = np.stack([left[t], right[t]], axis=1).astype(np.intp)
            child[leaf] = np.flatnonzero(leaf)[:, None]
            child, cut, node = child.ravel(), threshold[t], np.zeros(len(x), dtype=np.intp)
            for _ in range(depth):
                node = child[2 * node + (flat[base + axis[node]] > cut[node])]
            total += path[t, node]
        return pd.Series(np.power(2.0, -total / len(feature) / norm))

    return score(*[F.col(f"`{c}`") for c in columns])
