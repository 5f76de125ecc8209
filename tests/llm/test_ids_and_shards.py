"""Ids that articles give their own parts; shards by size and the index in batches."""

from __future__ import annotations

import numpy as np
import pytest

from assay.llm import arrow_shards, page_text
from assay.llm.common import new_path
from assay.llm.tokens import tokenizer_path


@pytest.mark.parametrize(
    ("part", "stays"),
    [
        ('<h2 id="discussion">Words here</h2>', True), ('<section id="related-work"><p>Words here</p></section>', True), ('<h2 id="search-methods">Words here</h2>', True),
        ('<p id="copyright-law">Words here</p>', True), ('<section id="discussion"><p>Words here</p></section>', True), ('<div id="share-of-votes"><p>Words here</p></div>', True),
        ('<div id="comments"><p>Words here</p></div>', False), ('<section id="comments"><p>Words here</p></section>', False), ('<div id="comment-list"><p>Words here</p></div>', False),
        ('<div id="sidebar">Words here</div>', False), ('<p class="advert">Words here</p>', False), ('<section class="related">Words here</section>', False),
    ],
)
def test_ids_in_articles(part, stays):
    page = f"<body><div id='search-methods'>menu</div><article><h1>Title</h1><p>Text.</p>{part}<p>End.</p></article></body>"
    kept = [line for line, kind in page_text.lines_of(page) if kind != page_text.BOILER]
    assert kept == ["Title", "Text.", *["Words here"] * stays, "End."]


def test_index_is_written_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_shards, "INDEX_ROWS", 3)
    writer = arrow_shards.ShardWriter(str(tmp_path / "x.arrow"), 8, 2, "uint16")
    ids = [np.arange(n, dtype="<u4") for n in (0, 1, 40, 7, 3, 8, 16, 2)]
    for i, x in enumerate(ids):
        writer.add(i, x)
    assert writer.close() == 77
    shard = arrow_shards.Shard(str(tmp_path / "x.arrow"))
    assert shard.index.num_record_batches == 3
    assert [(i, s, x.tolist()) for i, s, x in shard.documents()] == [(i, sum(map(len, ids[:i])), x.tolist()) for i, x in enumerate(ids)]


def test_shards_follow_the_size(spark):
    rows = [(i if i < 20 else None if i < 60 else 7, f"text number {i % 50} " * (i % 9)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "shards-test")
    shards = arrow_shards.write_shards(docs, folder, tokenizer_path("byte_bpe_50k.json"), 2, shard_bytes=1500)
    held = shards.collect()
    assert len(held) > 5 and max(r.n_docs for r in held) < 60 and sum(r.n_docs for r in held) == 120
    got = arrow_shards.read_shards(shards).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == np.cumsum([0, *(r.n_tokens for r in placed)])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in placed]
    assert order == sorted(order)
