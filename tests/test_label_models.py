"""Cross-fitted calibration, three labels, permutations with refits."""

from __future__ import annotations

import numpy as np
import pytest

from assay.operators import label_noise


def test_isotonic():
    got = label_noise.isotonic(np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 3]))
    assert got == pytest.approx([0.1, 0.35, 0.35, 0.35, 0.825, 0.825])
    assert label_noise.isotonic(np.arange(3.0), np.array([3.0, 2.0, 1.0]), np.ones(3)) == pytest.approx([2.0] * 3)


def test_calibration_improves_rows_that_curves_have_not_seen(spark):
    r = np.random.default_rng(1)
    n, k, classes = 3000, 3, 3
    true = r.dirichlet([1.0, 1.0, 1.0], n)
    label = np.array([r.choice(classes, p=t) for t in true])
    sharp = true**4 / (true**4).sum(1, keepdims=True)  # too sure of itself
    rows = [(i, int(y), i % k, p.tolist()) for i, (y, p) in enumerate(zip(label, sharp, strict=True))]
    probs = spark.createDataFrame(rows, "key long, label int, fold int, p array<double>")
    got = {x.key: np.array(x.p) for x in label_noise.calibrated(probs, k, classes).collect()}
    hot = np.eye(classes)[label]
    brier = lambda p: float(((p - hot) ** 2).sum(1).mean())
    after = np.array([got[i] for i in range(n)])
    assert after.sum(1) == pytest.approx(np.ones(n))
    assert brier(after) < brier(sharp) - 0.02
    assert brier(after) < brier(true) + 0.02
    # Labels of a fold don't touch its own curves.
    other = [(i, 0 if f == 0 else y, f, p) for i, y, f, p in rows]
    again = {x.key: x.p for x in label_noise.calibrated(spark.createDataFrame(other, probs.schema), k, classes).where("fold = 0").collect()}
    assert all(again[i] == pytest.approx(got[i].tolist()) for i in range(0, n, 3))


def test_three_labels(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(150):
        c = i % 3
        x, y = r.normal([(0, 0), (6, 0), (0, 6)][c], 1.0)
        rows.append((i, "abc"[c if i >= 6 else (c + 1) % 3], float(x), float(y)))
    df = spark.createDataFrame(rows, "k long, y string, x double, z double")
    probs, votes, labels, warned = label_noise.out_of_fold(df, "k", "y", ["x", "z"], k=3, boosts=4)
    assert labels == ["a", "b", "c"] and not warned
    assert {len(v.votes) for v in votes.collect()} == {4}
    got = {x.key: x for x in label_noise.noise_scores(probs).collect()}
    assert sum(got[i].flagged for i in range(6)) >= 5 and sum(got[i].flagged for i in range(6, 150)) <= 8
    assert all(abs(sum(x.p) - 1) < 1e-9 for x in probs.collect())


def test_too_many_labels(spark):
    df = spark.range(2000).selectExpr("id AS k", "id * 1.5 AS y", "id AS x")
    with pytest.raises(ValueError, match="labels"):
        label_noise.out_of_fold(df, "k", "y", ["x"])
    assert "classes" in label_noise.why_skipped(df, "y")


def test_refits_tell_labels_from_chance(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    real, chance = (x[:, 0] > 0).astype(int), r.integers(0, 2, 300)
    for y, low in ((real, True), (chance, False)):
        own = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "key long, label int, x0 double, x1 double")
        got = label_noise.refit_test(own, 2, rounds=20)
        assert got["null_mean"] > 0.3
        assert (got["p_value"] < 0.05 and got["effect_size"] < -3) if low else got["p_value"] > 0.02
        again = label_noise.refit_test(own.repartition(7), 2, rounds=20)
        assert again == pytest.approx(got)
    assert label_noise.refit_test(own, 2, rounds=4)["p_value"] is None


def test_folds_follow_the_rows(spark):
    df = spark.range(5000).selectExpr("id AS key", "cast(id % 7 = 0 as int) AS label")
    got = label_noise.folds(df, 5, rows_each=500).groupBy("label", "fold").count().collect()
    assert len(got) == 10
    for label, n in ((0, 4285), (1, 715)):
        counts = [r["count"] for r in got if r.label == label]
        assert sum(counts) == n and max(counts) - min(counts) <= 30
