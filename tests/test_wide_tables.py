"""Dependencies of wide tables by sketches, and resamples by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assay.operators import constraints, quality


def wide(spark, columns=18, n=400):
    r = random.Random(5)
    rows = []
    for _ in range(n):
        row = [r.randrange(r.choice([5, 40])) for _ in range(columns - 4)]
        row += [row[0] // 2, row[1] % 7, row[2] * 100 + row[3], (row[0] + row[1]) % 11]
        rows.append([None if r.random() < 0.01 and k == 4 else str(x) for k, x in enumerate(row)])
    return spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(columns)))


def test_sketches_rule_out_nothing_that_holds(spark, monkeypatch):
    df = wide(spark)
    names = df.columns
    key = lambda rows: sorted(map(tuple, rows))
    plain = {}
    monkeypatch.setattr(constraints, "WIDE", 100)
    plain[1] = key(constraints.dependencies(df, names).collect())
    known = {((r[0],), r[1]) for r in plain[1]}
    plain[2] = key(constraints.dependencies(df, names[-8:], 2, known=known).collect())
    monkeypatch.setattr(constraints, "WIDE", 3)
    assert key(constraints.dependencies(df, names).collect()) == plain[1]
    assert key(constraints.dependencies(df, names[-8:], 2, known=known).collect()) == plain[2]
    assert {("c0", "c14"), ("c1", "c15"), ("c16", "c2"), ("c16", "c3")} <= {r[:2] for r in plain[1]}
    some = constraints.plausible(df, names, 1, 0.95)
    assert {((r[0],), r[1]) for r in plain[1]} <= some and len(some) < 0.5 * len(names) * (len(names) - 1)


def test_many_columns_take_few_scans(spark, monkeypatch):
    df = spark.range(300).select(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20 + i)).alias(f"c{i}") for i in range(60)))
    sets = []
    original = constraints.sketched
    monkeypatch.setattr(constraints, "sketched", lambda d, s, *a: sets.append(len(s)) or original(d, s, *a))
    assert constraints.plausible(df, df.columns[:40], 1, 0.95) is not None
    assert sets == [40 + 40 * 39 // 2]


@pytest.mark.parametrize("rows_each", [40, 250_000])
def test_resamples_by_ranges(spark, rows_each):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 10 == 0, None).otherwise("s").alias("s"))
    got = quality.bootstrap(df, "k", replicates=12, rows=100, rows_each=rows_each).orderBy("replicate").collect()
    assert [r.replicate for r in got] == list(range(12)) and len({round(r.score, 6) for r in got}) > 3
    whole = quality.bootstrap(df.repartition(5), "k", replicates=12, rows=100).orderBy("replicate").collect()
    assert [r.score for r in got] == pytest.approx([r.score for r in whole])
