"""What grows with a table is neither broadcast nor held by one task."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from assay.functions import graph, ranks
from assay.operators import anomalies, dense_duplicates, near_duplicates, profile
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parts_table(spark):
    return spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("part number "), (F.col("id") % 90).cast("string")).alias("s"), (F.col("id") % 7).alias("x"))


def test_forest_values_are_worked_out_once_for_all_rows(monkeypatch):
    r = np.random.default_rng(8)
    calls, made = [], anomalies.shares_of
    monkeypatch.setattr(anomalies, "shares_of", lambda *a: calls.append(1) or made(*a))
    tree = anomalies.grow(r.normal(size=(256, 3)), r)
    x = r.normal(size=(500, 3)) * 2
    x[0, 0], x[1, 1], x[2, 2] = np.nan, np.inf, -np.inf
    found = anomalies.path_attributions([tree, tree], x)
    assert len(calls) <= 6  # once for each number of features, not for each leaf
    want = np.zeros(x.shape)
    for features, low, high, shares, path in anomalies.boxes(tree):
        inside = ((x[:, features] > low) & (x[:, features] <= high)).astype(float)
        want[:, features] += path * made(inside, shares)
    assert found == pytest.approx(want, abs=1e-9)
    held = anomalies.worked_out(tree, 3)
    assert anomalies.tree_attributions(held, x, few=1) == pytest.approx(want, abs=1e-9)


def test_keys_to_explain_are_not_broadcast(spark):
    df = parts_table(spark).withColumn("y", F.col("x") * 1.5)
    assert "BroadcastHashJoin" not in plan(anomalies.forest_attributions(df, "k", ["x", "y"], df.where("x > 3").select("k"), trees=3))


def test_near_duplicates_broadcast_no_rows(spark):
    df = parts_table(spark)
    for found in (near_duplicates.candidates(df, "k", ["s", "x"]), near_duplicates.pairs(df, "k", ["s", "x"]), dense_duplicates.dense_pairs(df, "k", ["s"])):
        assert "BroadcastHashJoin" not in plan(found) and found.count() > 0
    assert "BroadcastHashJoin" not in plan(near_duplicates.clusters(near_duplicates.pairs(df, "k", ["s", "x"])))


def test_signatures_do_not_travel_to_bands(spark):
    nan = float("nan")
    rows = [(i, ["Ünïté of Wörds and 日本語\tLong  ones", " X ", "", None, "a\u00a0b"][i % 5], [i % 3, None][i % 7 == 0], [1.5, nan, -0.0][i % 3], i % 2 == 0, [i % 2, i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, s string, x int, y double, z boolean, m array<int>").withColumn("d", (F.col("k") % 5).cast("decimal(9,2)"))
    names = df.columns[1:]
    sigs = {r.k: np.array(r.sig) for r in df.select("k", near_duplicates.signatures(near_duplicates.token_hashes(near_duplicates.row_tokens(df, names))).alias("sig")).collect()}
    texts = df.select("k", *(near_duplicates.value_text(df, c).cast("binary").alias(c) for c in names)).collect()
    for r in texts:
        least = np.min([near_duplicates.value_minima(c, None if r[c] is None else bytes(r[c]), 128) for c in names], axis=0)
        assert (least == sigs[r.k]).all()
    found = near_duplicates.candidates(df, "k", names)
    assert "sig#" not in plan(found)
    bands = {k: s.reshape(32, 4) for k, s in sigs.items()}
    first = {}
    for r in texts:
        first.setdefault(tuple(r[1:]), r.k)
    want = {(first[tuple(r[1:])], r.k, 1.0) for r in texts if first[tuple(r[1:])] != r.k}
    for a in first.values():
        want |= {(a, b, (sigs[a] == sigs[b]).mean()) for b in first.values() if a < b and (bands[a] == bands[b]).all(axis=1).any() and (sigs[a] == sigs[b]).mean() >= 0.64}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 60
    assert near_duplicates.met(df, "k", names, block=7)[0].count() == sum(w[0] in first.values() and w[1] in first.values() for w in want)


def test_bands_by_tiles_and_pair_by_pair_agree():
    r = np.random.default_rng(3)
    short = r.integers(0, 3, (128, 300)).astype(np.uint8)
    for a, b, c, d in ((0, 300, 0, 300), (10, 190, 190, 300)):
        start = np.arange(300) + 1 if a == c else np.full(300, c)
        many = np.where((np.arange(300) >= a) & (np.arange(300) < b), d - start, 0)
        few, wide = ({(x, y) for one, two in found for x, y in zip(one.tolist(), two.tolist(), strict=True)} for found in (near_duplicates.likely_of_few(short, start, many, 50), near_duplicates.likely_of_many(short, a, b, c, d, 50)))
        same = (short[:, a:b, None] == short[:, None, c:d]).sum(axis=0)
        assert few == wide == {(i + a, j + c) for i, j in zip(*np.nonzero(same >= 50), strict=True) if i + a < j + c}


def test_components_in_as_many_parts_as_there_are_links(spark):
    links = spark.range(300).select((F.col("id") % 100 + 1000).alias("a"), F.floor(F.col("id") / 60).alias("b")).union(spark.range(50).select((F.col("id") + 5000).alias("a"), F.lit(9000).alias("b")))
    want = None
    for rows, many in ((1 << 20, 1 << 17), (20, 1 << 17), (20, 8)):  # one part; many; and hubs whose links stay where they are
        got = sorted(map(tuple, graph.components(links, "a", "b", rows=rows, many=many).collect()))
        want = want or got
        assert got == want and len({c for _, c in got}) == 2
    both = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    assert "BroadcastHashJoin" not in plan(graph.tied(both, both, 4, 1000))
    hubs = plan(graph.tied(both, both, 4, 20))
    assert "BroadcastHashJoin" in hubs and "SortMergeJoin" in hubs


def test_nodes_that_hang_on_one_take_no_part_in_rounds(spark, monkeypatch):
    r = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (150, 2))] + [(k % 20, 1000 + k) for k in range(500)] + [(5000, 4999), (6000, 6001), (6000, 6001), (7, 7), (8001, 8000), (8002, 8000)]
    df = spark.createDataFrame(links, "a long, b long")
    want = sorted(map(tuple, graph.components(df, "a", "b").collect()))
    seen, made = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links, *a: seen.append(links.count()) or made(links, *a))
    assert sorted(map(tuple, graph.hung_components(df, "a", "b").collect())) == want
    assert len(seen) == 1 and seen[0] < 150
    tables = [pa.RecordBatch.from_pydict({"a": [a for a, _ in links[i : i + 50]], "b": [b for _, b in links[i : i + 50]]}) for i in range(0, len(links), 50)]
    for rows in (60, 10000):
        left = [(x, y) for t in graph.forests(iter(tables), rows) for x, y in zip(*t.to_pydict().values(), strict=True)]
        assert rows == 60 or len(left) < len({x for link in links for x in link})
        assert sorted(map(tuple, made(spark.createDataFrame(left, "a long, b long"), "a", "b").collect())) == want


def test_ranks_are_counted_without_multiplied_rows(spark):
    own = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v0"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v1"))
    spans = [((0, -np.inf, 10.0, 0), [3.0]), ((1, 100.0, 200.0, 0), [150.0]), ((0, 50.0, np.inf, 0), [])]
    found = ranks.placed(own, spans)
    assert "Generate" not in plan(found)
    got = {(r.k, r.code): r["count"] for r in found.groupBy("k", "code").count().collect()}
    assert got == {(0, 0): 30, (0, 1): 10, (0, 2): 60, (2, 0): 490, (1, 0): 24, (1, 1): 1, (1, 2): 24}


def test_shards_are_trained_side_by_side_with_their_own_results(monkeypatch):
    r = np.random.default_rng(6)
    blocks = [r.normal(size=(n, 3)) for n in (130, 64, 7, 200, 1)]
    moments, layers, calls = r.random((2, len(anomalies.Autoencoder(3).vectors))) * 1e-3, anomalies.Autoencoder.layers, []

    def trained(some):
        return anomalies.Autoencoder(3, seed=9).train([blocks[i] for i in some], [np.random.default_rng(i) for i in some], moments, 4, 3, 32, 1e-2)

    alone = [trained([i]) for i in range(len(blocks))]
    monkeypatch.setattr(anomalies.Autoencoder, "layers", lambda self, *a: calls.append(1) or layers(self, *a))
    found, done = trained(range(len(blocks)))
    assert len(calls) == 3 * 7  # steps of the longest block, not of all
    assert found == pytest.approx(np.concatenate([v for v, _ in alone]), abs=1e-12) and list(done) == [4 + 3 * k for k in (5, 2, 1, 7, 1)]


def test_distinct_values_are_counted_in_narrow_rows(spark):
    nan = float("nan")
    rows = [(i % 5, i, [i % 2], {"a": i % 3}, nan if i % 4 == 0 else float(i % 2), -0.0 if i % 2 else 0.0, None, f"t{i % 7}", i % 2 == 0, (i % 2, None)) for i in range(40)]
    df = spark.createDataFrame(rows, "s short, id long, many array<int>, m map<string,int>, `x.y` double, zero double, none int, t string, b boolean, own struct<p:int,q:string>")
    df = df.withColumn("money", F.col("id").cast("decimal(9,2)")).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s").cast("int")))
    found = profile.cardinality(df)
    wide = [out.count(",") + 1 for out in re.findall(r"Expand \[\[.*\]\], \[(.*)\]", plan(found))]
    assert wide and max(wide) == 2  # position and value: a row does not hold all columns counted
    got = [(r["column"], r.n_rows, r.n_present, r.n_unique) for r in found.collect()]
    assert got == [(n, 40, *p) for n, p in zip(df.columns, [(40, 5), (40, 40), (40, 2), (40, 3), (30, 2), (40, 1), (0, 0), (40, 7), (40, 2), (40, 2), (40, 40), (40, 5)], strict=True)]
    assert [(r["column"], r.n_rows, r.n_present, r.n_unique, r.uniqueness_ratio) for r in profile.cardinality(df.limit(0), ["id", "t"]).collect()] == [("id", 0, 0, 0, 0.0), ("t", 0, 0, 0, 0.0)]
    columns = spark.range(20).select(*((F.col("id") % (i + 1)).alias(f"c{i}") for i in range(11)))
    assert [r.n_unique for r in profile.cardinality(columns).collect()] == list(range(1, 12))
