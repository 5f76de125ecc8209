"""Sketches by file, and runs that are whole or not there."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from assay.operators import profile, sketches
from assay.plans.engine import Analyzer, Config
from assay.sources.results import ResultStore


def test_sketches_of_new_files_alone(spark, tmp_path):
    table, kept = str(tmp_path / "table"), str(tmp_path / "kept")
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 1000)).alias("s"))
    part(0, 20_000).repartition(3).write.parquet(table)
    store = sketches.SketchStore(spark, kept)
    assert store.update(table) == 3 and store.update(table) == 0
    part(20_000, 30_000).coalesce(1).write.mode("append").parquet(table)
    assert store.update(table) == 1
    assert store.kept().count() == 4 * 3
    got = {r["column"]: r for r in store.profile(table).collect()}
    assert {n: (r.n_rows, r.n_present) for n, r in got.items()} == {"k": (30_000, 30_000), "x": (30_000, 30_000), "s": (30_000, 22_500)}
    for name, exact in (("k", 30_000), ("x", 100), ("s", 750)):
        assert got[name].n_unique == pytest.approx(exact, rel=4 * 1.04 / 2 ** (sketches.BITS / 2))
    assert (got["x"].least, got["x"].greatest, got["x"].mean) == (0.0, 99.0, pytest.approx(49.5)) and got["s"].p50 is None
    for p in sketches.PERCENTS:
        assert got["k"][f"p{round(100 * p)}"] == pytest.approx(30_000 * p, abs=0.02 * 30_000)
    first = next(f for f in sorted(os.listdir(table)) if f.endswith(".parquet"))
    os.remove(os.path.join(table, first))
    left = spark.read.parquet(table).count()
    assert store.update(table) == 0 and {r.n_rows for r in store.profile(table).collect()} == {left} and left < 30_000


def test_approximate_cardinality(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10).alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r["column"]: r for r in profile.cardinality(df, approximate=True).collect()}
    assert got["id"].potential_identifier and got["few"].n_unique == 10 and got["few"].low_cardinality and got["none"].n_unique == 0
    assert got["id"].n_unique == pytest.approx(5000, rel=0.04)
    assert profile.cardinality(df, approximate=True).columns == profile.cardinality(df).columns


def test_runs_are_whole(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    assert store.runs() == [] and store.clean() == 0
    assert store.save({"a": {"n": 1}}, {"t": spark.range(3), "u": spark.range(1)}, "one") == "one"
    with pytest.raises(ValueError, match="one"):
        store.save({}, {}, "one")
    broken = spark.range(3).select(F.raise_error(F.lit("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        store.save({"a": {"n": 2}}, {"t": spark.range(3), "z": broken}, "two")
    assert store.runs() == ["one"] and store.results("one") == {"a": {"n": 1}} and store.table("one", "t").count() == 3
    with pytest.raises(KeyError):
        store.table("two", "t")
    assert store.clean() == 1 and store.table("one", "u").count() == 1
    assert store.save({}, {"t": spark.range(2)}, "two") == "two" and store.runs() == ["one", "two"]
    store.drop("one")
    assert store.runs() == ["two"] and store.clean() == 0


def test_engine_saves_its_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, "ab"[i % 2]) for i in range(30)], "k long, x int, s string")
    on = dict.fromkeys(("near_duplicates", "outliers", "reconstruction", "label_noise", "constraints", "quality", "summary"), False)
    found = Analyzer(spark, df, Config(**on, key="k")).analyze()
    run = found.save(str(tmp_path / "runs"))
    store = ResultStore(spark, str(tmp_path / "runs"))
    assert store.runs() == [run] and set(store.results(run)) == set(found.results())
    assert store.table(run, "missing").count() == 3 and set(store.manifest(run)["tables"]) == set(found.context.tables)
