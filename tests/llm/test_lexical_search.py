"""Ranks by brute force and by SQL, with nulls, ties, repeated rows and letters of other scripts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd

from assay.llm import lexical_search

DOCS = "doc_id long, text string, item string, term string, row int, n int"
ITEMS = "item_id long, text string, doc string"
LOWER = str.maketrans(lexical_search.CAPITALS, lexical_search.SMALL)


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(LOWER))


def ranked(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, -1 if d is None else d))
        out += [(i, r, None if d < 0 else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def example():
    r = random.Random(5)
    words = ["the", "of", "été", "Éa", "x1", "東京", "ſo", "don", "t", "𝔘x", *[f"w{i}" for i in range(60)]]
    docs = [(i, " ".join(r.choice(words[: r.choice([6, 70])]) for _ in range(r.randrange(1, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,;\n"), (103, "The-of don't w1_w2 W3"), (None, "the w5 w5"), (None, "the w5 w5"), (7, "w5 the"), (104, "w9 " * 40_000)]
    docs += [(200 + i, "the same text w7 w8") for i in range(15)]
    items = [(0, "the OF w1 w2"), (1, "w7 w8 same"), (2, None), (3, "unheard"), (None, "w5 the the"), (4, "東京 Éa été ſo 𝔘x"), (0, "w3"), (5, "w9")]
    return docs, items


def test_ranks(spark, monkeypatch):
    docs, items = example()
    rows = [(d, t, "i", "t", 1, 2) for d, t in docs], [(i, t, "d") for i, t in items]
    tables = spark.createDataFrame(rows[0], DOCS), spark.createDataFrame(rows[1], ITEMS)
    order = lambda found: sorted([tuple(x) for x in found], key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = ranked(docs, items, 10)
    assert order(lexical_search.search(*tables).collect()) == want
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical_search, "SLICE", 7)
    assert order(lexical_search.search(*tables, k=3).collect()) == ranked(docs, items, 3)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    db.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert order(db.sql(lexical_search.search_sql()).fetchall()) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b", None)], ITEMS)
    assert lexical_search.search(docs, one).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "a b", None, None, None, None)], DOCS), items).collect() == []
    assert lexical_search.search(docs, items).collect() == []


def test_postings_are_whole(spark):
    docs = spark.createDataFrame([(d, t, "", "", 0, 0) for d, t in example()[0]], DOCS)
    wanted = spark.createDataFrame([("w5",), ("the",), ("",)], "term string")
    got = Counter((r.doc, r.term, r.tf, r.n) for r in lexical_search.build_postings(docs, wanted, True).collect() if r.term)
    want = Counter((d, w, c[w], sum(c.values())) for d, t in example()[0] for c in [Counter(terms(t))] for w in ("w5", "the") if c[w])
    assert got == want
