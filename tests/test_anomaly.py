import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift import CONFIG, Dataset
from tabsift.config import with_config
from tabsift.dataset import shared_folder
from tabsift.operators import anomaly, injection, neighbours, privacy, quantiles
from tabsift.operators.quantiles import exact_quantiles
from tabsift.operators.ranking import global_position, seeded_key


def brute_force_lof(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    k_distance = dist[:, -1]
    density = 1.0 / (np.maximum(k_distance[near], dist).mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / density


@pytest.mark.parametrize("copies,leaf,questions", [(0, 40, 7), (200, 25, 5), (5, 10_000, 4_000)])
def test_lof_equals_brute_force(spark, copies, leaf, questions):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(400, 3)), rng.normal(6, 0.1, size=(40, 3)), np.full((copies, 3), 0.5), [[30.0, 30.0, 30.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double").repartition(5)
    factors = neighbours.local_outlier_factor(df, ["a", "b", "c"], 12, leaf_points=leaf, questions=questions)
    got = {r["row_id"]: r["lof"] for r in df.join(factors, ["a", "b", "c"]).select("row_id", "lof").collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute_force_lof(x, 12), rtol=1e-9)


def gridded(n):
    """Few distinct values, so many neighbours are equally far."""
    rng = np.random.default_rng(11)
    return np.unique(np.column_stack([rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 7, n)]).astype(float), axis=0)


def test_boxes_are_split_until_they_are_small(spark):
    x = gridded(5000)
    points = spark.createDataFrame([(i, 1, *map(float, r)) for i, r in enumerate(x)], "pid long, weight long, x0 double, x1 double, x2 double").repartition(4)
    tree, placed = neighbours.boxes(points, ["x0", "x1", "x2"], 5, 60)                  # a sample of 60 can't split 700 points at once
    counts = [r["count"] for r in placed.groupBy("box").count().collect()]
    assert sum(counts) == len(x) and max(counts) <= 10 and len(counts) == tree["n"][0]
    assert np.array_equal(np.sort(tree["leaf"][tree["leaf"] >= 0]), np.arange(len(counts)))


def test_factors_do_not_depend_on_partitions(spark):
    x = gridded(1500)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, `a.b` double, b double, c double")
    columns, got = ["a.b", "b", "c"], []
    for parts, leaf in ((2, 30), (7, 200)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = anomaly.outlier_factors(rows.repartition(parts), columns, 12, leaf_points=leaf, sample_points=50).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        got.append({r["row_id"]: r["lof"] for r in found})
    assert got[0].keys() == got[1].keys() == set(range(len(x)))
    assert np.allclose([got[0][i] for i in range(len(x))], [got[1][i] for i in range(len(x))], rtol=1e-12)
    assert np.allclose([got[0][i] for i in range(len(x))], brute_force_lof(x, 12), rtol=1e-9)       # rows are in the order of coordinates, as ties are


def test_only_the_factors_stay_on_the_shared_storage(spark):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(gridded(300))], "row_id long, a double, b double, c double")
    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    factors = neighbours.local_outlier_factor(df, ["a", "b", "c"], 12, leaf_points=50)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("rows-") and factors.count() == df.count()


def test_few_distances_are_measured_inside_a_box(monkeypatch):
    """The neighbours are those of brute force, from a small part of all distances."""
    rng = np.random.default_rng(4)
    x, measured = np.round(rng.random((4_000, 3)), 2), []
    ids, weights, plain = np.arange(len(x)) * 3, rng.integers(1, 3, len(x)), neighbours.squares
    monkeypatch.setattr(neighbours, "squares", lambda a, b: (measured.append(len(a) * len(b)), plain(a, b))[1])
    row, distance, pid, count = neighbours.nearest_pairs(x, ids, x, ids, weights, 7, None)
    d = np.sqrt(plain(x, x))
    alone = np.flatnonzero(weights <= 1)
    d[alone, alone] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert np.array_equal(pid.reshape(-1, 7), ids[near]) and np.array_equal(distance.reshape(-1, 7), np.take_along_axis(d, near, axis=1))
    assert np.array_equal(count, weights[near].ravel() - (near == np.arange(len(x))[:, None]).ravel())
    found = neighbours.nearest_pairs(x[:50] + 0.001, -1 - np.arange(50), x, ids, weights, 7, np.full(50, 0.05))
    assert np.all(found[1] <= 0.05 * (1 + 1e-8)) and sum(measured) < len(x) ** 2 / 3


def test_far_points_do_not_choose_where_boxes_are_split():
    """One point far off along the first axis, while the others spread along the second."""
    x = np.column_stack([np.linspace(0, 0.1, 400), np.linspace(0, 9, 400)])
    x[-1, 0] = 1_000.0
    tree = neighbours.learn_splits(x, 2)
    assert tree["axis"][0] == 1 and np.bincount(neighbours.assign(tree, x)).tolist() == [200, 200]


@pytest.mark.parametrize("leaf", [None, 200])
def test_a_box_is_searched_in_several_tasks(spark, monkeypatch, leaf):
    """The leaves of a box are dealt out to tasks, with copies, equal distances and questions of other boxes; each point has one factor."""
    monkeypatch.setattr(neighbours, "FEWEST_POINTS", 30)
    monkeypatch.setattr(neighbours, "LOCAL_POINTS", 8)
    x = gridded(700)
    x = np.vstack([x, x[::7], x[::7], np.repeat(x[:1], 15, axis=0), [[90.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double").repartition(3)
    points = neighbours.weighted_points(df, ["a", "b", "c"])
    assert min(neighbours.Search(points, ["x0", "x1", "x2"], 12, leaf_points=leaf).parts.values()) > 1
    factors = neighbours.local_outlier_factor(df, ["a", "b", "c"], 12, leaf_points=leaf, questions=100).collect()
    order = np.lexsort(x.T[::-1])
    lof = brute_force_lof(x[order], 12)
    want = {tuple(map(float, r)): v for r, v in zip(x[order], lof)}
    got = {(r["a"], r["b"], r["c"]): r["lof"] for r in factors}
    assert len(factors) == len(got) and got.keys() == want.keys() and np.allclose([got[r] for r in got], [want[r] for r in got], rtol=1e-9)


def test_neighbour_lists_are_not_stored(spark, monkeypatch):
    """Only points that reach into other boxes have anything of their neighbours written."""
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(gridded(2_500))], "row_id long, a double, b double, c double")
    entries, plain = [], neighbours.cut_lineage

    def counted(table, folder=None):
        out = plain(table, folder)
        found = [F.sum(F.size(f.name)) for f in out.schema.fields if f.dataType.typeName() == "array"]
        entries.extend(n or 0 for n in (out.agg(*found).first() if found else ()))
        return out

    monkeypatch.setattr("tabsift.dataset.cut_lineage", counted)
    got = {}
    for leaf in (None, 60):
        entries.clear()
        got[leaf] = {r["row_id"]: r["lof"] for r in anomaly.outlier_factors(df, ["a", "b", "c"], 12, leaf_points=leaf).collect()}
        assert len(entries) >= 3 and (sum(entries) == 0 if leaf is None else sum(entries) > 0)
    assert got[None].keys() == got[60].keys() and np.allclose([got[None][i] for i in got[60]], list(got[60].values()), rtol=1e-12)


def test_missing_coordinates_are_an_error(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) if i else None) for i in range(60)], "a double, b double")
    with pytest.raises(Exception, match="coordinate missing"):
        neighbours.local_outlier_factor(df, ["a", "b"], 5).collect()


@pytest.mark.parametrize("scale", [1.0, 1e170])
def test_bounds_from_products_lose_no_neighbour(scale):
    """Far from the origin, where products round, and so large that their squares overflow."""
    rng = np.random.default_rng(21)
    x = np.vstack([np.round(rng.random((900, 4)), 2) + 1e6, rng.normal(size=(100, 4)) * 1e3]) * scale
    x = x[np.lexsort(x.T[::-1])]
    ids, plain = np.arange(len(x)), neighbours.squares
    with np.errstate(over="ignore", invalid="ignore"):
        row, distance, pid, _ = neighbours.nearest_pairs(x, ids, x, ids, np.ones(len(x), int), 9, None)
        d = np.sqrt(plain(x, x))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :9]
    if scale == 1.0:
        assert np.array_equal(pid.reshape(-1, 9), near)
    assert np.array_equal(distance[np.isfinite(distance)], np.take_along_axis(d, near, axis=1)[np.isfinite(np.take_along_axis(d, near, axis=1))])


def test_both_strictnesses_share_one_measurement(spark, monkeypatch):
    rng = np.random.default_rng(19)
    ds = Dataset.of("t", spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(200, 3)))], "row_id long, a double, b double, c double"), "row_id")
    alone = [anomaly.detect(ds, c, {}, p) for c, p in ((["a", "b"], False), (["a", "b", "c"], True))]
    stored, plain = [], anomaly.stored_matrix
    monkeypatch.setattr(anomaly, "stored_matrix", lambda *a: (stored.append(a[1]), plain(*a))[1])
    together = anomaly.detections(ds, [(["a", "b"], False), (["a", "b", "c"], True), (["a"], True)], {})
    assert stored == [["a", "b", "c"]] and together[2].flags is None
    for a, b in zip(alone, together):
        assert a.methods == b.methods and sorted(a.flags.collect()) == sorted(b.flags.collect()) and a.footprint.collect() == b.footprint.collect()


def test_large_brackets_are_narrowed_without_rounds(spark, monkeypatch):
    """Room for 25 values per bracket, where the first sketch leaves 200."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=40_000), rng.integers(0, 9, 40_000), np.where(rng.random(40_000) < 0.4, 0.1, rng.normal(size=40_000))])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double").repartition(4)
    monkeypatch.setattr(quantiles, "FEW", 0)
    monkeypatch.setattr(quantiles, "order_statistics", None)
    shares = [0.25, 0.5, 0.75, 0.99]
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, shares, kept=300)
    assert all(np.allclose(got[c], np.quantile(x[:, i], shares), rtol=1e-14) for i, c in enumerate(df.columns))


def test_columns_with_dots_reach_all_detectors(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 2)))], "row_id long, `glu.x` double, `b c` double")
    found = anomaly.detect(Dataset.of("t", df, "row_id"), ["glu.x", "b c"], {}, True)
    assert found.flags.count() == 300 and set(found.methods) == {"iqr", "modified_z", "isolation_forest", "local_outlier_factor"}


def test_nothing_runs_when_a_dataset_is_made(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    Dataset.of("t", df, "k")
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before


@pytest.mark.parametrize("accuracy,kept", [(2000, 500_000), (2000, 0), (100, 0), (8, 0), (8, 400)])
def test_quantiles_match_numpy(spark, accuracy, kept):
    """With and without room for the values between a sketch's brackets, which leaves them to rounds."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 20, 3000))      # one value holds 40 % of the rows
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b)] + [(None, None)], "a double, b double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, shares, accuracy, kept)
    assert np.allclose(got["a"], np.quantile(a, shares)) and np.allclose(got["b"], np.quantile(b, shares))


def test_quantiles_of_all_columns_are_two_scans(spark):
    """Many columns and shares, ties at the bracket's ends, infinite values, NaN and NULL."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=40_000), rng.integers(0, 9, 40_000), np.exp(rng.normal(size=40_000) * 9), np.where(rng.random(40_000) < 0.01, np.inf, 0.0), np.full(40_000, 3.0)])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double, d double, e double").repartition(5)
    df = df.union(spark.createDataFrame([(None, float("nan"), None, None, None)] * 50, df.schema)).cache()
    df.count()
    shares, scheduler = [0.25, 0.5, 0.75, 0.99], spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, shares)
    assert scheduler.nextJobId() - before <= 6                                # a look at the table's beginning and two aggregations; each may be two jobs
    assert all(np.allclose(got[c], np.quantile(x[:, i], shares)) for i, c in enumerate(df.columns) if c != "d")
    assert got["d"][:3] == [0.0, 0.0, 0.0] and got["d"][3] in (0.0, np.inf)


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(1000, 2)), [[9.0, 9.0], [-9.0, 8.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double").repartition(3)
    scored = anomaly.isolation_scores(df, ["a", "b"], CONFIG)
    top = [r["row_id"] for r in scored.orderBy(F.desc("isolation_score")).limit(2).collect()]
    assert sorted(top) == [1000, 1001]
    assert 0 < scored.agg(F.min("isolation_score")).first()[0] <= scored.agg(F.max("isolation_score")).first()[0] <= 1


def test_learned_detectors_flag_about_the_contamination(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    ds = Dataset.of("d", spark.createDataFrame(rows, "row_id long, a double, b double"), "row_id")
    found = anomaly.detect(ds, ["a", "b"], {}, True)
    share = anomaly.contamination(600, CONFIG)
    counts = {r["method"]: r["flagged_rows"] for r in anomaly.anomaly_summary(found.flags, found.methods).collect()}
    assert found.flags.count() == 600
    assert abs(counts["isolation_forest"] - 600 * share) <= 2 and abs(counts["local_outlier_factor"] - 600 * share) <= 2


def test_gate_on_rows_and_columns(spark):
    ds = Dataset.of("d", spark.createDataFrame([(i, float(i), 1.0) for i in range(29)], "row_id long, a double, b double"), "row_id")
    assert anomaly.detect(ds, ["a", "b"], {}, True).flags is None
    assert anomaly.detect(ds, ["a"], {}, True, 1000).flags is None


def test_global_position_is_the_full_sort(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), seeded_key(F.col("id"), 42).alias("key")).repartition(7)
    got = [r["row_id"] for r in global_position(df, "key", 777).orderBy("position").collect()]
    want = [r["row_id"] for r in df.orderBy("key").limit(777).collect()]
    assert got == want


def test_injection_counts_and_metrics(spark):
    plain = with_config(anomaly={m: {**CONFIG["anomaly"][m], "enabled": False} for m in ("isolation_forest", "local_outlier_factor")})
    rng = np.random.default_rng(13)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(10, 1, size=(333, 2)))]
    ds = Dataset.of("d", spark.createDataFrame(rows, "row_id long, a double, b double"), "row_id", config=plain)
    broken, truth = injection.inject_errors(ds, ["a", "b"], 333, 0.05)
    assert truth.count() == 16 and broken.df.count() == 333
    assert broken.df.where("a is null or b is null").count() == truth.where("error_type = 'set_missing'").count()
    before = anomaly.detect(ds, ["a", "b"], {}, False)
    m = injection.evaluate(before, anomaly.detect(broken, ["a", "b"], {}, False), truth)
    # Every visible error is found unless its row was flagged before; moved quantiles may flag other rows too.
    visible = truth.where("error_type <> 'set_missing'").join(before.flags.where("not ensemble_flag"), "row_id").count()
    assert round(m["precision"] * m["newly_flagged_rows"]) == visible and m["injected_error_rows"] == 16


def test_k_anonymity(spark):
    sizes = {"a": 1, "b": 4, "c": 5, None: 10}
    df = spark.createDataFrame([(k, "v") for k, n in sizes.items() for _ in range(n)], "q string, v string")
    row = privacy.k_anonymity(df, ["q", "absent"], CONFIG).first()
    assert (row["min_equivalence_class"], row["n_classes"], row["at_risk_fraction"]) == (1, 4, 0.25) and row["k_score"] == 0.5
    assert privacy.k_anonymity(df, [], CONFIG).first()["assessable"] is False
    assert privacy.k_anonymity(df.limit(0), ["q"], CONFIG).first()["assessable"] is False
    assert privacy.class_size_per_record(df.withColumn("id", F.monotonically_increasing_id()), "id", ["q"]).where("q is null").first()["class_size"] == 10
