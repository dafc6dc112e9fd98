import pytest
from pyspark.sql import functions as F

from tabsift.config import CONFIG, with_config
from tabsift.plans import assess as plan
from tabsift.sources import commits, tables

PLAIN = with_config(anomaly={m: {**CONFIG["anomaly"][m], "enabled": False} for m in ("isolation_forest", "local_outlier_factor")}, injection={"rates": []})


def _tables(spark, name, n):
    return {t: spark.range(n).select(F.lit(name).alias("dataset"), "id", F.lit(t).alias("t")) for t in ("first", "second")}


def test_tables_of_a_run_are_seen_together_or_not_at_all(spark, tmp_path):
    base = str(tmp_path)
    assert commits.committed(spark, base, "first") is None and commits.finished(spark, base) == {}
    commits.commit(spark, base, "a", _tables(spark, "a", 3), "v1")
    commits.commit(spark, base, "b", _tables(spark, "b", 2), "v1")
    broken = _tables(spark, "a", 9)
    broken["second"] = spark.range(5).select(F.lit("a").alias("dataset"), F.raise_error(F.lit("killed")).cast("long").alias("id"), F.lit("x").alias("t"))
    with pytest.raises(Exception, match="killed"):
        commits.commit(spark, base, "a", broken, "v2")                    # its first table was written
    assert commits.committed(spark, base, "first").groupBy("dataset").count().orderBy("dataset").collect() == [("a", 3), ("b", 2)]
    assert commits.finished(spark, base) == {"a": "v1", "b": "v1"}
    commits.commit(spark, base, "a", _tables(spark, "a", 9), "v2")
    assert commits.committed(spark, base, "second").where("dataset = 'a'").count() == 9 and commits.finished(spark, base)["a"] == "v2"


def test_a_second_run_goes_on_where_the_first_stopped(spark, tmp_path, monkeypatch):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    for name in ("clinic", "survey"):
        (data / f"{name}.csv").write_text("\n".join(["pid;age;sex"] + [f"{i};{20 + i % 50};{'m' if i % 2 else 'f'}" for i in range(40)]))
    calls, real, stop = [], plan.assess, {"survey"}

    def counted(ds, *args, **kwargs):
        calls.append(ds.name)
        if ds.name in stop:
            raise RuntimeError("lost")
        return real(ds, *args, **kwargs)

    monkeypatch.setattr(plan, "assess", counted)
    first = {r.dataset: r.status for r in plan.assess_folder(spark, str(data), None, str(out), PLAIN).collect()}
    assert first == {"clinic": "ok", "survey": "failed"} and tables.read_table(spark, str(out), "schema_profile").select("dataset").distinct().count() == 1
    stop.clear()
    second = {r.dataset: r.status for r in plan.assess_folder(spark, str(data), None, str(out), PLAIN).collect()}
    assert second == {"clinic": "ok", "survey": "ok"} and sorted(calls) == ["clinic", "survey", "survey"]
    assert tables.read_table(spark, str(out), "all_dataset_quality_profiles").count() == 2
