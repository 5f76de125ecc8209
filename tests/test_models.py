from __future__ import annotations

import numpy as np
import pytest

from assay.functions.graph import components
from assay.operators import anomalies, label_noise, near_duplicates, quality, summary
from assay.plans.engine import REGISTRY, Analyzer, Component, Config, ordered, register
from assay.report import html
from assay.report.explain import Explainer


@pytest.fixture(scope="module")
def cloud(spark):
    random = np.random.default_rng(1)
    rows = [(i, *map(float, random.normal(0, 1, 3))) for i in range(400)] + [(1000 + i, 9.0, -9.0, 9.0 + i) for i in range(4)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double")


def test_isolation_forest_finds_planted_rows(cloud):
    got = anomalies.isolation_forest(cloud, "k", ["a", "b", "c"], trees=50).orderBy("score", ascending=False).limit(4).collect()
    assert {r.k for r in got} == {1000, 1001, 1002, 1003}
    assert all(0 < r.score <= 1 and r.outlier for r in got)


def test_reconstruction_finds_broken_pattern(spark):
    rows = [(i, float(i % 37), 2.0 * (i % 37), -1.0 * (i % 37)) for i in range(300)] + [(999, 30.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    for errors in (anomalies.pca_errors(df, "k", ["a", "b", "c"]), anomalies.autoencoder_errors(df, "k", ["a", "b", "c"], epochs=30)):
        assert errors.orderBy("error", ascending=False).first().k == 999
    high = anomalies.high_errors(anomalies.pca_errors(df, "k", ["a", "b", "c"]), "k")
    assert 0 < anomalies.error_summary(high).first().high_error_ratio < 0.1


def test_near_duplicates_chain(spark):
    rows = [(1, "a long company name here", 10.0), (2, "a long company name herr", 10.0), (3, "a long company name herr", 10.1), (4, "something else entirely", 900.0), (5, "something else entirely", 900.0)]
    df = spark.createDataFrame(rows, "k long, s string, x double")
    found = near_duplicates.pairs(df, "k", ["s", "x"])
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    assert (4, 5) in got and got[4, 5] == 1.0 and (2, 3) in got
    assert not any({a, b} & {1, 2, 3} and {a, b} & {4, 5} for a, b in got)
    assert {r.cluster for r in near_duplicates.clusters(found).collect()} >= {4}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100


def test_flipped_labels_are_found(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(300):
        label = i % 2
        x = random.normal(4 * label, 1)
        rows.append((i, float(x), float(random.normal()), 1 - label if i % 30 == 0 else label))
    df = spark.createDataFrame(rows, "k long, x double, z double, y int")
    probs, votes, labels, _ = label_noise.out_of_fold(df, "k", "y", ["x", "z"], k=3)
    flagged = {r.key for r in label_noise.noise_scores(probs).where("flagged").collect()}
    assert len(flagged & set(range(0, 300, 30))) >= 8 and len(flagged) < 40
    assert 0.5 < label_noise.agreement(votes).first()[0] <= 1


def test_noise_type():
    assert label_noise.noise_type([[1.0, 0.0], [0.0, 1.0]]) == ("uniform", 0.95)
    assert label_noise.noise_type([[0.9, 0.1], [0.1, 0.9]])[0] == "uniform"


def test_risk_and_issues():
    assert summary.overall_risk({}) == "unknown"
    assert summary.overall_risk({"a": {"risk_level": "critical"}}) == "critical"
    assert summary.total_issues({"a": {"noise_ratio": 0.1, "total_violations": 3}}) == 4
    assert quality.why_skipped(0) and quality.why_skipped(3) and not quality.why_skipped(5)


def test_order_follows_needs():
    assert ordered(["summary", "quality", "label_noise"]) == ["label_noise", "quality", "summary"]


def test_engine_isolates_failures_and_writes_a_report(spark, tmp_path):
    @register
    class Broken(Component):
        name = "broken"

        def analyze(self, context, **options):
            raise RuntimeError("no <luck>")

    try:
        df = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(12)], "k long, s string")
        seen = []
        config = Config(key="k", near_duplicates=False, constraints=False, quality=False)
        done = Analyzer(spark, df, config, log=seen.append).analyze()
    finally:
        del REGISTRY["broken"]
    got = done.results()
    assert got["broken"]["status"] == "failed" and got["outliers"]["status"] == "skipped"
    assert got["overview"]["n_rows"] == 12 and got["summary"]["status"] == "done" and "overview" in seen
    page = open(done.generate_report(str(tmp_path / "r.html")), encoding="utf-8").read()
    assert "<svg" in page and "no &lt;luck&gt;" in page and "<script" not in page


def test_explainer_falls_back():
    class Bad:
        def generate(self, prompt):
            raise ValueError

    said = Explainer(Bad())
    assert "score" in said.outlier({"a": 1}, 0.7, {"a": 2.0})
    said.disable()
    assert not said.available


def test_value_texts():
    assert html.value_text("duplicate_ratio", 0.25, 8) == "25.0% (2 of 8 rows)"
    assert html.markdown("**a** b\n- c") == "<b>a</b> b<br><ul><li>c</li></ul>"


def test_permutation_test_on_a_small_table(spark):
    rows = [(i, i % 2 if i >= 3 else 1 - i % 2, [0.95, 0.05] if i % 2 == 0 else [0.05, 0.95]) for i in range(40)]
    probs = spark.createDataFrame(rows, "key long, label int, p array<double>")
    got = label_noise.permutation_test(probs)
    assert got["p_value"] == 0 and got["significant"] and 0.3 < got["null_mean"] < 0.7 and got["effect_size"] < -2
    moved = label_noise.shuffled_labels(probs.select("key", "label"), 4, rows_each=7)
    by = {}
    for r in moved.collect():
        by.setdefault(r["round"], {})[r["key"]] = r["label"]
    assert all(sorted(x) == list(range(40)) and sum(x.values()) == sum(r[1] for r in rows) for x in by.values()) and len({tuple(sorted(x.items())) for x in by.values()}) == 4
    refit = label_noise.permutation_test(probs, rounds=5, refit=lambda labels: labels.join(probs.select("key", "p"), "key"))
    assert refit["p_value"] == 0
    assert label_noise.permutation_test(probs, rounds=4)["p_value"] is None


def test_components_like_union_find(spark):
    import random

    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent if x not in alone}


def test_near_duplicate_bands_in_blocks(spark):
    rows = [(f"k{i:03d}", f"the same long text with number {i % 3}", float(i % 2)) for i in range(30)] + [(f"z{i}", f"something else {i * 7919}", 100.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, t string, x double")
    whole, parts = (sorted(map(tuple, near_duplicates.candidates(df, "key", ["t", "x"], block=b).collect())) for b in (512, 2))
    assert whole == parts and len(whole) == len(set(whole)) > 20 and all(a < b for a, b, _ in whole)


def test_intrinsic_dimension_is_among_the_features(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 17)) for i in range(50)], "a double, b double, c double")
    got = quality.meta_features(df).first()
    assert got["dimension_ratio"] == pytest.approx(2 / 3) and got["spectral_noise"] == pytest.approx(0)
