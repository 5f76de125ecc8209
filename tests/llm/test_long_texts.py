"""One very long text among short ones, for the operators on documents that have no such test elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assay.llm import arrow_shards, licenses, mixing, packing, telephony, toxicity
from assay.llm.tokens import tokenizer_path

LONG = " ".join(f"word{i % 997}, and\nmore{i % 31}." for i in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "s"), (2, "short text", "s"), (3, None, "t"), (4, LONG, "t"), (5, "word1, and", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_telephony(docs):
    got = {r.doc_id: r for r in telephony.media_table(docs).collect()}
    payload = LONG.encode() + b"\xff" * (-len(LONG.encode()) % 576)
    assert got[1].n_bytes == len(LONG.encode()) and got[1].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert got[1].media_sha256 == got[4].media_sha256 and got[1].feature == got[4].feature


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(2, 0), (5, 0), (1, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 5 and got[1].score == got[4].score and all(0 <= r.score <= 1 for r in got.values())


def test_mixing(docs):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1]["size"] == len(LONG.split()) == got[4]["size"] and all(r.taken <= 3 * r["size"] for r in got.values())


def test_packing_and_shards(docs):
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1)
    assert sum(r[2] for r in own) == len(words.encode(LONG, add_special_tokens=False).ids) + 1
    assert [r[1] for r in own] == np.cumsum([0, *(r[2] for r in own)])[:-1].tolist() and {r[2] for r in own[:-1]} == {2048}
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in arrow_shards.token_files(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert got[1].n_tokens == len(plain.encode(LONG, add_special_tokens=False).ids) + 1 == got[4].n_tokens and got[1].ids_crc32 == got[4].ids_crc32


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].digest == got[4].digest and got[1].n_canonical > 300_000 and got[1].license is None
