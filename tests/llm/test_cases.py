"""Empty tables, repeated rows, null and large ids, very long texts for all operators; packing against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from assay.llm import arrow_shards, embedding_dups, licenses, mixing, packing, page_text, shingle_join, telephony, toxicity, url_rules
from assay.llm.common import saved
from assay.llm.tokens import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, key string"
PAGES = "page_id long, url string, html string, host string, part int"
LARGE = (1 << 60) + 1
RULES = "verdict string, host string, path string"


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


BY_DOCUMENTS = {
    "telephony": telephony.media_table,
    "toxicity": lambda docs: toxicity.score_documents(docs, labels_of(docs.sparkSession, [(1, 1, 1), (2, 1, 0), (3, None, None)])),
    "mixing": mixing.mix,
    "packing": lambda docs: packing.pack(docs, WORDS),
    "licenses": licenses.scan_licenses,
    "shingles": shingle_join.link_documents,
    "shards": lambda docs: arrow_shards.token_files(docs, BYTES),
}


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "a b c d e f", "a b c d e f", "é" * 3, "x " * 3000, "id*ot \x00 \t"]
    out = [(i, t, "en", ("s", "t", None)[i % 3], 1, 0, "k") for i, t in enumerate(texts)]
    return [*out, *out, (None, "a b c d e f", None, None, None, None, None), (None, None, None, None, None, None, None), (LARGE, "large", "en", "s", 1, 0, "k")]


@pytest.mark.parametrize("name", BY_DOCUMENTS)
def test_documents(spark, rows, name):
    got = BY_DOCUMENTS[name](spark.createDataFrame(rows, DOCS)).collect()
    whole = [r for r in got if name != "packing" or r.piece == 0]
    assert Counter(r.doc_id for r in whole) == Counter(r[0] for r in rows)
    by = {}
    for r in whole:
        plain = {k: v for k, v in r.asDict().items() if k not in ("again", "start", "sequence_id", "offset", "copies", "taken")}
        assert r.doc_id is None or by.setdefault(r.doc_id, plain) == plain
    assert BY_DOCUMENTS[name](spark.createDataFrame([], DOCS)).collect() == []


def test_pages(spark):
    rows = [(1, "http://a/x", "<p>one</p>", "h", 0), (1, "http://a/x", "<p>one</p>", "h", 0), (None, None, None, None, None), (LARGE, "http://a/" + "y" * 100_000, "", "h", 1), (4, "no scheme", "<p>x", "h", 1)]
    pages, none = spark.createDataFrame(rows, PAGES), spark.createDataFrame([], PAGES)
    rules = spark.createDataFrame([("block", "a", "/y"), ("allow", None, None)], RULES)
    texts = Counter((r.page_id, r.text) for r in page_text.extract_pages(pages).collect())
    assert texts == Counter([(1, "one"), (1, "one"), (None, ""), (LARGE, ""), (4, "x")])
    assert Counter((r.page_id, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()) == Counter([(1, "allow"), (1, "allow"), (None, "allow"), (LARGE, "block"), (4, "allow")])
    assert page_text.extract_pages(none).collect() == [] and url_rules.judge_urls(none, rules).collect() == []
    assert url_rules.judge_urls(pages, rules.limit(0)).count() == 5


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, rep long"
    rows = [(1, [1.0, 0.0], 0, 1), (1, [1.0, 0.0], 0, 1), (LARGE, [2.0, 0.0], 0, 1), (LARGE + 1, [0.0, 1.0], 0, 1), (None, [1.0, 0.0], 0, None), (None, None, None, None)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dups.link_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got[1, 2, 1] == 2 and got[LARGE, 2, 1] == 1 and got[LARGE + 1, 0, LARGE + 1] == 1 and got[None, 0, None] == 2 and sum(got.values()) == 6
    assert embedding_dups.link_vectors(spark.createDataFrame([], kind)).collect() == []


def test_decoded_audio_is_stored_and_read_back(spark):
    texts = ["hello " * 100, "", None, "ü" * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for kind in (telephony.MULAW, telephony.ALAW):
        stored = saved(telephony.store_payloads(docs, kind=kind), "media")
        pcm = {r.doc_id: np.frombuffer(r.pcm, "<i2") for r in saved(telephony.decode(stored, 16_000), "pcm").collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            full = np.frombuffer(raw + b"\xff" * (-len(raw) % 576 if raw else 576), np.uint8)
            table = telephony.mulaw_table() if kind == telephony.MULAW else telephony.alaw_table()
            assert len(pcm[i]) == 2 * len(full) and (pcm[i] == telephony.resample(table[full], 8000, 16_000)).all()


def packed_one_by_one(counts, capacity):
    """Bins by trying everything, a bin at a time."""
    left, bins = Counter(counts), []
    while +left:
        held, gap = [], capacity
        while fits := [x for x in +left if x <= gap]:
            held.append(max(fits))
            left[held[-1]] -= 1
            gap -= held[-1]
        if gap and len(held) > 1:
            small = held[-1]
            own = sorted((+left).elements())
            sums = [(a + b, -a) for i, a in enumerate(own) for b in own[i + 1 :] if a + b <= gap + small]
            if sums and max(sums)[0] > small:
                total, first = max(sums)
                two = sorted((-first, total + first))
                left.subtract(two)
                left[small] += 1
                held = held[:-1] + two
        bins.append(tuple(sorted(held)))
    return Counter(bins)


def test_best_two_fit_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.randrange(5, 40)
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 6) for _ in range(r.randrange(1, 9))}
        got = Counter()
        for held, n in packing.bin_kinds(counts, capacity):
            got[tuple(sorted(held))] += n
        assert got == packed_one_by_one(counts, capacity), (counts, capacity)


def test_pipeline_of_odd_and_of_no_documents(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels_of(spark, [(2, 1, 0), (3, 1, 1)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(r.length > 0 and r.ids_crc32 >= 0 for r in got)
    other = tmp_path / "none"
    docs.limit(0).write.parquet(str(other / "documents.parquet"))
    labels_of(spark).write.parquet(str(other / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(other)).collect() == []
