"""Dense near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np

from assay.operators import dense_duplicates
from assay.operators.near_duplicates import row_tokens
from pyspark.sql import functions as F


def example(spark, n=220):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "fex", "gro") for b in ("ta", "mik", "los", "ner", "pul")]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(25))
        rows.append((4 * i, text, "x"))
        other = text.split()
        other[r.randrange(25)] = r.choice(words)
        if i % 2:
            rows.append((4 * i + 1, " ".join(other), "x"))
        if i % 5 == 0:
            rows.append((4 * i + 2, text, "x"))
    return spark.createDataFrame(rows, "k long, s string, t string")


def brute(df, names, cosine):
    held = sorted((r.k, np.asarray(r.h, np.int64)) for r in df.select("k", F.transform(row_tokens(df, names), lambda t: F.xxhash64(t)).alias("h")).collect())
    x = dense_duplicates.vectors([h for _, h in held]).astype(float)
    keys = [k for k, _ in held]
    return {(keys[i], keys[j]): float(x[i] @ x[j]) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= cosine}


def test_recall_and_precision(spark):
    df = example(spark)
    want = brute(df, ["s", "t"], 0.9)
    for block in (512, 3):
        rows = dense_duplicates.dense_pairs(df, "k", block=block).collect()
        got = {(r.a, r.b): r.cosine for r in rows}
        assert len(got) == len(rows)
        reps = {p for p in want if not any(k % 4 == 2 for k in p)}  # a copy is paired with its first row alone
        assert len(reps & set(got)) >= 0.9 * len(reps) and len(reps) > 80
        assert all(abs(want[p] - c) < 1e-5 for p, c in got.items())
        assert {p for p in got if p[1] % 4 == 2} == {(4 * i, 4 * i + 2) for i in range(0, 220, 5)}


def test_rows_without_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "one two three"), (5, "one two three")], "k long, s string")
    got = {(r.a, r.b) for r in dense_duplicates.dense_pairs(df, "k").collect()}
    assert (4, 5) in got and (1, 3) in got and not any({1, 2} == {*p} or 4 in p and 1 in p for p in got)
    assert dense_duplicates.dense_pairs(df.limit(0), "k").collect() == []
