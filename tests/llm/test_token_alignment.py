"""Alignment against a walk along both token rows of each whole text, and against the plan of rows alone."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from assay.llm import token_alignment
from assay.llm.token_alignment import Pair
from assay.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, row int, codes string, n long"


def walk(pair, text):
    """n_a, n_b, groups and links of a whole text; None without tokens."""
    if not text:
        return None
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    if not pair.is_whole(f" {text}", a, b):
        return None
    groups, links, rest_a, rest_b = [([], [])], [], list(a), list(b)
    left_a = left_b = 0
    while rest_a or rest_b:
        if left_a == 0:
            now_a = rest_a[0]
            left_a = len(pair.bytes_a[now_a])
            groups[-1][0].append(now_a)
        if left_b == 0:
            now_b = rest_b[0]
            left_b = len(pair.bytes_b[now_b])
            groups[-1][1].append(now_b)
        links.append((now_a, now_b))
        step = min(left_a, left_b)
        left_a, left_b = left_a - step, left_b - step
        rest_a, rest_b = rest_a[left_a == 0 :], rest_b[left_b == 0 :]
        if left_a == left_b == 0 and (rest_a or rest_b):
            groups.append(([], []))
    return len(a), len(b), groups, links


def texts():
    r = random.Random(8)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "ing", "é", "ü", "東", "\U0001f600", ".", ",", "'s", " ", "　", "<s>", "</s>", "<|endoftext|>", "<0x41>", "­", "é", "x▁y", "0", "12", "\x00", "​"]
    out = ["".join(r.choice(signs) for _ in range(r.randrange(1, 14))) for _ in range(250)]
    words = ["the", "hello", "Wörter,", "ciónrra.", "don't", "(x)", "1234", "\nNew", "été;"]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return [*out, None, "", " ", "\n", "a", "▁", "the " * 20_000 + "end", "x" * 30_000, " ".join(words), " ".join(words)]


@pytest.fixture(scope="module")
def pair():
    return Pair(A, B)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_alignment(spark, pair, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT", hot)
    own = texts()
    rows = [(i, t, 1, "c", 2) for i, t in enumerate(own)] + [(None, "the hello", None, None, None)] * 2
    walked = [walk(pair, r[1]) for r in rows]
    counts = Counter(x for w in walked if w for x in set(w[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)

    def expected(w):
        if w is None:
            return (0,) * 6 + ("",)
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in w[2]).encode()).hexdigest()
        return w[0], w[1], len(w[2]), len(w[3]), sum(counts[x] == best[x[0]] for x in w[3]), sum(counts[x] for x in w[3]), digest

    got = [tuple(r) for r in token_alignment.align(spark.createDataFrame(rows, DOCS), A, B).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted([(r[0], *expected(w)) for r, w in zip(rows, walked, strict=True)], key=key)
    assert token_alignment.align(spark.createDataFrame([], DOCS), A, B).collect() == []


def test_plan_of_rows(spark, pair):
    own = [t for t in texts() if not t or len(t) < 5000]
    docs = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in enumerate(own)], DOCS).coalesce(1)
    tokens = token_alignment.token_arrays(docs, A, B)
    ids = {r.row: r.id for r in tokens.select("row", "id").collect()}
    links, groups = {}, {}
    for r in token_alignment.align_rows(tokens).collect():
        links.setdefault(ids[r.row], []).append((r.a_place, r.b_place, r.a_id, r.b_id))
        groups.setdefault(ids[r.row], set()).add(r.number)
    for i, t in enumerate(own):
        w = walk(pair, t)
        assert [x[2:] for x in sorted(links.get(i, []))] == (w[3] if w else [])
        assert groups.get(i, set()) == (set(range(len(w[2]))) if w else set())


def test_pieces_are_kept_within_bounds(pair, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT", 10)
    own = [f"w{i} w{i + 1} the" for i in range(200)]
    for _ in range(2):
        for i in range(0, 200, 20):
            got = pair.align(own[i : i + 20])
            assert got["n_links"].tolist() == [len(walk(pair, t)[3]) for t in own[i : i + 20]]
            assert len(pair.kept) <= 10
