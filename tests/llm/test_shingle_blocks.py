"""The shingle join where one shingle's rows are many blocks, and where common shingles are told by an absolute bound."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from assay.llm import shingle_join


def corpus():
    """Short documents about common passages, of which few link: their prefixes hold shingles that many others have."""
    r = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(4)]
    out = []
    for i in range(160):
        own = " ".join(f"d{i // r.choice([1, 1, 2])}x{j}" for j in range(r.choice([2, 3, 12])))
        out.append(f"{passages[i % 4]} {own}")
    return [*out, *passages, *out[:5]]


@pytest.mark.parametrize(("block", "floor"), [(1024, 2048), (3, 2048), (7, 4), (1, 20)])
def test_components(spark, monkeypatch, block, floor):
    monkeypatch.setattr(shingle_join, "CROSS_BLOCK", block)
    monkeypatch.setattr(shingle_join, "HOT_FLOOR", floor)
    texts = dict(enumerate(corpus()))
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = shingle_join.exact_jaccard_links(texts)
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in shingle_join.link_documents(docs).collect()}
    assert got == {i: root(i) for i in texts}
    assert len(set(got.values())) > 20


def test_hot_shingles_are_counted_in_all_documents(spark):
    texts = dict(enumerate(corpus()))
    held = Counter(x for t in texts.values() for x in shingle_join.shingle_sets([t])[0].tolist())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for cells in (7, 40, 1 << 12):  # few cells are all full
        for least in (5, 30, 200):
            got = shingle_join.hot_shingles(docs, len(texts), 5, cells, least / len(texts))
            assert list(zip(got["shingle"].tolist(), got["documents"].tolist(), strict=True)) == sorted((x, n) for x, n in held.items() if n >= least)
    assert len([n for n in held.values() if n >= 5]) > 20


def test_blocks_meet_once(spark):
    """Every pair of rows of a shingle is in one group, and is met there."""
    import pandas as pd

    n, blocks = 30, 4
    rows = []
    for doc in range(n):
        for other in range(blocks):
            own = doc % blocks
            rows.append({"shingle": 5, "level": 1, "place": 0, "head": bytes(8 * shingle_join.HEAD), "doc_id": doc, "component": doc // 2, "n": 10, "common": 10, "depth": 1, "leader0": doc, "shared0": 10, "block": own, "low": min(own, other), "high": max(own, other)})
    part = pd.DataFrame(rows).sort_values(["shingle", "low", "high", "component", "doc_id"])
    got = [(a, b) for x in shingle_join.crossing(iter([part.iloc[:50], part.iloc[50:51], part.iloc[51:]]), 75, 1) for a, b in zip(x.a, x.b, strict=True)]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2]
