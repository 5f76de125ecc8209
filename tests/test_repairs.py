"""Exact quantiles by rank, attributions of forest scores, training over shards, and results that used to be wrong."""

from __future__ import annotations

import json
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.ranks import exact_quantiles
from assay.operators import anomalies, categorical, constraints, near_duplicates, numeric, summary
from assay.plans.engine import Analyzer, Config
from assay.sources.readers import Source


@pytest.mark.parametrize("few", [4096, 40, 1])
def test_quantiles(spark, few):
    r, n = np.random.default_rng(1), 12_000
    held = {"a": r.normal(size=n), "b": r.integers(0, 3, n).astype(float), "c": np.where(r.random(n) < 0.5, 1.0, 2.0), "d": np.round(r.exponential(size=n), 2), "e": np.full(n, 7.0), "f": np.where(r.random(n) < 0.9, np.nan, r.normal(size=n)), "g": np.full(n, np.nan)}
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame(held)), [F.nanvl(F.col(c), F.lit(None)) for c in held], shares, few=few)
    for values, found in zip(held.values(), got, strict=True):
        own = values[~np.isnan(values)]
        assert found == ([None] * 6 if not len(own) else pytest.approx(np.quantile(own, shares).tolist(), rel=1e-12, abs=1e-12))


def test_quantiles_need_no_window(spark):
    calls = []
    original = type(spark.range(1)).collect
    try:
        type(spark.range(1)).collect = lambda self: calls.append(self._jdf.queryExecution().toString()) or original(self)
        exact_quantiles(spark.range(50_000).select(F.col("id").cast("double").alias("x")), [F.col("x")], [0.5])
    finally:
        type(spark.range(1)).collect = original
    assert calls and not any("Window" in plan for plan in calls)


def expected_path(tree, x, known, node=0):
    f = int(tree["feature"][node])
    if f < 0:
        return tree["path"][node]
    left, right = int(tree["left"][node]), int(tree["right"][node])
    if f in known:
        return expected_path(tree, x, known, left if x[f] <= tree["cut"][node] else right)
    return sum(tree["rows"][c] / tree["rows"][node] * expected_path(tree, x, known, c) for c in (left, right))


@pytest.mark.parametrize("width", [1, 2, 4, 6])
def test_attributions_against_all_subsets(width):
    r = np.random.default_rng(width)
    trees = [anomalies.grow(np.round(r.normal(size=(40, width)), 1), r) for _ in range(4)]
    x = np.round(r.normal(size=(7, width)) * 2, 1)
    got = anomalies.path_attributions(trees, x)
    for row, own in zip(x, got, strict=True):
        want = np.zeros(width)
        for f in range(width):
            for k in range(width):
                for s in combinations([g for g in range(width) if g != f], k):
                    w = math.factorial(k) * math.factorial(width - 1 - k) / math.factorial(width)
                    want[f] += w * np.mean([expected_path(t, row, {*s, f}) - expected_path(t, row, set(s)) for t in trees])
        assert own == pytest.approx(want, abs=1e-9)
        assert own.sum() == pytest.approx(np.mean([expected_path(t, row, set(range(width))) - expected_path(t, row, set()) for t in trees]), abs=1e-9)


def test_scores_of_all_trees_at_once():
    r = np.random.default_rng(2)
    trees = [anomalies.grow(r.normal(size=(60, 3)), r) for _ in range(9)] + [anomalies.grow(np.zeros((60, 3)), r)]
    x = r.normal(size=(50, 3)) * 3
    paths = [np.mean([expected_path(t, row, {0, 1, 2}) for t in trees]) for row in x]
    assert anomalies.forest_scores(anomalies.packed(trees), 60, x, at_once=7) == pytest.approx(2.0 ** (-np.array(paths) / float(anomalies.path_length(60))))


def test_reasons_name_the_odd_feature(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, r.normal(size=3))) for i in range(300)] + [(999, 0.0, 25.0, 0.0)], "k long, a double, b double, c double")
    got = anomalies.forest_attributions(df, "k", ["a", "b", "c"], df.where("k = 999").select("k"), trees=40).collect()
    assert len(got) == 1 and got[0].features[0].feature == "b" and got[0].features[0].attribution < 0 and got[0].difference < 0


def test_autoencoder_learns_from_all_rows_whatever_the_partitions(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=900)
    rows = [(i, float(b), float(2 * b + 0.1 * r.normal()), float(-b)) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    options = {"epochs": 20, "shard_rows": 300}
    one = {x.k: x.error for x in anomalies.autoencoder_errors(df.repartition(7), "k", ["a", "b", "c"], **options).collect()}
    two = {x.k: x.error for x in anomalies.autoencoder_errors(df.coalesce(1), "k", ["a", "b", "c"], **options).collect()}
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9 and len(one) == 900
    alone = {x.k: x.error for x in anomalies.autoencoder_errors(df, "k", ["a", "b", "c"], epochs=20, shard_rows=10_000).collect()}
    assert np.mean(list(one.values())) < 1.0 and np.mean(list(alone.values())) < 0.5


def test_sample_of_a_column_with_nulls(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("label"), (F.col("id") % 3).alias("__n"))
    got = numeric.sampled(df, 100, "k", "label")
    assert got.columns == df.columns
    assert {r.label: r.n for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"x": 50, None: 50}
    again = numeric.sampled(df.repartition(5), 100, "k", "label")
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in again.collect())
    same = df.withColumn("k", F.lit(1))  # equal keys have equal hashes: the bound lets none or all through
    assert numeric.sampled(same, 100, "k", "label").count() == 100


def test_dates_behind_gaps(spark):
    df = spark.range(400).select(F.when(F.col("id") >= 150, F.lit("2024-01-05")).alias("d"), F.when(F.col("id") == 3, "x").otherwise("2024-01-05").alias("bad"), F.lit("y").alias("text"), F.lit(None).cast("string").alias("none"))
    assert constraints.temporal_columns(df) == ["d", "bad"]


def test_scores_of_columns_with_commas(spark):
    df = spark.createDataFrame([(1.0, -2.0, "2024-02-01", "2024-01-01"), (3.0, 1.0, "2024-01-01", "2024-01-01")], "`rate,x` double, `a\\b,rate` double, `start_date,1` string, end_date string")
    broken = constraints.ranges(df).union(constraints.date_order(df)).union(constraints.rule(df, {"type": "sql", "condition": "`rate,x` < 2"}))
    assert {r["column"] for r in constraints.column_scores(broken).collect()} == {"rate,x", "a\\b,rate", "start_date,1", "end_date"}
    assert constraints.unlisted(constraints.listed(["a,b", "c\\", "d"])) == ("a,b", "c\\", "d")


def test_chi_square_without_a_grid(spark):
    r = np.random.default_rng(6)
    for kx, ky, n in ((2, 2, 9), (2, 2, 300), (3, 5, 12), (40, 60, 200)):
        x, y = r.integers(0, kx, n), r.integers(0, ky, n)
        df = spark.createDataFrame([(f"x{a}", f"y{b}") for a, b in zip(x, y, strict=True)], "a string, b string")
        for correct in (True, False):
            got = categorical.chi_square(df, ["a", "b"], correct).collect()
            table = pd.crosstab(x, y).to_numpy()
            e = np.outer(table.sum(1), table.sum(0)) / n
            gap, dof = np.abs(table - e), (table.shape[0] - 1) * (table.shape[1] - 1)
            gap = gap - np.minimum(0.5, gap) if correct and dof == 1 else gap
            assert [(pytest.approx(g.chi_square), g.dof) for g in got] == [((gap**2 / e).sum(), dof)]


def test_thresholds_of_strengths():
    told = lambda name, key, v: summary.strengths_and_weaknesses({name: {key: v}})
    for name, key, good, neither, bad in (("exact_duplicates", "duplicate_ratio", 0, 0.05, 0.06), ("outliers", "outlier_ratio", 0.04, 0.2, 0.21), ("label_noise", "noise_ratio", 0.04, 0.1, 0.11), ("constraints", "total_violations", 0, 5, 6), ("quality", "data_readiness_score", 0.8, 0.7, 0.59)):
        assert [tuple(map(len, told(name, key, v))) for v in (good, neither, bad)] == [(1, 0), (0, 0), (0, 1)]
    assert [tuple(map(len, told("missing_values", "num_columns_with_missing", v))) for v in (0, 2, 3)] == [(1, 0), (1, 0), (0, 1)]
    assert [tuple(map(len, told("near_duplicates", "near_duplicate_ratio", v))) for v in (0, 0.1, 0.11)] == [(0, 0), (0, 0), (0, 1)]


def test_json_of_columns_and_of_records(spark, tmp_path):
    own = tmp_path / "columns.json"
    own.write_text(json.dumps({"a": {"0": 1, "1": 2, "2": None}, "b": {"0": "x", "1": "y", "2": "{z} {"}, "c": {"0": 1.5, "1": 2, "2": 3}, "d": {"0": True, "1": False}}))
    got = Source.open(spark, str(own)).frame
    assert got.columns == ["a", "b", "c", "d"] and [t for _, t in got.dtypes] == ["bigint", "string", "double", "boolean"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x", 1.5, True), (2, "y", 2.0, False), (None, "{z} {", 3.0, None)], key=str)
    records = tmp_path / "records.json"
    records.write_text(json.dumps([{"a": 1, "b": {"x": 1}}, {"a": 2, "b": {"x": 2}}]))
    assert Source.open(spark, str(records)).frame.select("a", "b.x").orderBy("a").collect() == [(1, 1), (2, 2)]
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": {"x": 1}}\n{"a": {"x": 2}}\n')
    assert Source.open(spark, str(lines), multiLine=False).frame.count() == 2


def test_engine_options_and_texts(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], "cd"[i % 2], round(float(x) * 20) / 20, round(float(x) * 40 + i % 3) / 20, f"2024-01-{1 + i % 28:02d}") for i, x in enumerate(r.normal(size=120))]
    rows += [(500, "z", "c", 40.0, -90.0, "2024-01-01"), (501, "a", "c", rows[4][3], rows[4][4], rows[4][5])]
    df = spark.createDataFrame(rows, "k long, s string, t string, x double, y double, d string")
    on = dict.fromkeys(("overview", "missing_values", "exact_duplicates", "label_noise", "quality"), False)
    config = Config(**on, key="k", output_path=str(tmp_path / "default.html"), options={"categorical_outliers": {"chi_square": True, "adaptive": False, "least": 0.02}, "outliers": {"trees": 30}, "reconstruction": {"epochs": 5}})
    found = Analyzer(spark, df, config).analyze()
    got = found.results()
    assert {n: x["status"] for n, x in got.items()} == dict.fromkeys(got, "done"), got
    assert ("s", "t") in [(p["a"], p["b"]) for p in got["categorical_outliers"]["dependent_pairs"]]
    assert found.table("rare_values").collect() and {r["value"] for r in found.table("rare_values").collect()} >= {"z"}
    assert got["outliers"]["example_texts"] and got["reconstruction"]["example_texts"] and got["near_duplicates"]["example_texts"]
    assert any("groups" in x for x in got["near_duplicates"]["implications"])
    assert [r["column"] for r in got["constraints"]["temporal_statistics"]] == ["d"]
    opened = []
    import webbrowser

    original, webbrowser.open = webbrowser.open, opened.append
    try:
        found.generate_report(str(tmp_path / "other.html"))
        found.open_report()
    finally:
        webbrowser.open = original
    assert opened == [str(tmp_path / "other.html")]


def test_implications_have_figures():
    assert near_duplicates.implications({"total_pairs": 0}, []) == []
    said = near_duplicates.implications({"total_pairs": 50, "affected_rows": 40, "cluster_count": 15, "n_rows": 100}, [{"column": "a", "contribution": 0.9}, {"column": "b", "contribution": 0.1}])
    assert "25 of 100" in said[0] and "16 of 50" in said[1] and "a agrees" in said[2]
    assert len(near_duplicates.recommendations(0.5, {"affected_rows": 40, "cluster_count": 15})) == 3
