"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing names, against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assay.llm import arrow_shards, embedding_dups, licenses, mixing, packing, page_text, queries, shingle_join, telephony, toxicity, url_rules
from assay.llm.common import new_path, saved
from assay.llm import tokens
from assay.llm.tokens import Encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, bucket int, key string"


def docs_of(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None, "p", 7, None) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "zeta"]) + str(r.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    base = words(120, 1)
    near = [" ".join(base[:60] + [f"x{i}"] + base[60 + i % 3 :]) for i in range(5)]
    far = [" ".join(words(100, 50 + i)) for i in range(8)]
    return [None, "", "  \n ", "one two", "ONE  two", " ".join(base), " ".join(base).upper(), *near, *far, far[0], " ".join(words(30_000, 9)), "l'été 12.5, c'est\n\nvrai <|endoftext|> ok"]


def components_of(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_shingle_links(spark, corpus):
    docs = docs_of(spark, corpus)
    got = {r.doc_id: r for r in shingle_join.link_documents(docs).collect()}
    texts = dict(enumerate(corpus))
    want = components_of(texts, shingle_join.exact_jaccard_links(texts))
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    kept = shingle_join.keep_one_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert shingle_join.link_documents(docs.limit(0)).count() == 0


def test_shingle_links_of_many_near_copies(spark):
    r = random.Random(4)
    base = words(60, 2)
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"e{r.randrange(30)}"
        texts.append(" ".join(w))
    got = {x.doc_id: x.component_id for x in shingle_join.link_documents(docs_of(spark, texts), most_depth=4).collect()}
    assert got == components_of(range(80), shingle_join.exact_jaccard_links(dict(enumerate(texts))))


def test_repeated_rows_link(spark):
    docs = docs_of(spark, ["a b c d e f", "x"])
    got = shingle_join.link_documents(docs.union(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_ids_with_several_texts_and_null_ids(spark):
    a, b, c = "a b c d e f g h", "one two three four five six", "a b c d e f g h i"
    rows = [(5, a), (5, b), (7, a), (2, b), (5, c), (None, a), (None, "x"), (9, None), (9, ""), (9, "q"), (11, "q")]
    docs = spark.createDataFrame([(i, t, "m", 3) for i, t in rows], "doc_id long, text string, mark string, part int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.link_documents(docs).collect())
    assert got == Counter([(5, 4, 5), (5, 2, 2), (7, 4, 5), (2, 2, 2), (5, 5, 5), (None, 4, None), (None, 0, None), (9, 0, 9), (9, 0, 9), (9, 1, 9), (11, 1, 9)])
    kept = Counter((r.doc_id, r.text) for r in shingle_join.keep_one_each(docs).collect())
    assert sum(n for (i, t), n in kept.items() if t in (a, c) and i == 5) == 1 and kept[2, b] == kept[9, "q"] == kept[None, a] == 1
    assert (5, b) not in kept and (7, a) not in kept and (11, "q") not in kept


def test_hot_shingles_and_long_texts(spark, monkeypatch):
    r = random.Random(3)
    shared = " ".join(words(30, 77))
    texts = [f"{' '.join(words(20, i))} {shared if i % 3 else ''} {' '.join(words(r.randrange(60), 900 + i // 2))}" for i in range(150)]
    texts += ["w " * 700_000 + "end", "w  " * 700_000 + "end", f"x {'y' * 1_500_000} a b c", f"x {'Y' * 1_500_000} A b c"]
    want = components_of(range(154), shingle_join.exact_jaccard_links(dict(enumerate(texts))))
    for sample in (4000, 40):
        got = {x.doc_id: x.component_id for x in shingle_join.link_documents(docs_of(spark, texts), hot_sample=sample, hot_share=0.2).collect()}
        assert got == want
    assert len(shingle_join.hot_shingles(docs_of(spark, texts), 154, 5, 4000, 0.2)) >= 20
    monkeypatch.setattr(shingle_join, "BLOCK", 64)
    assert [sorted(s) for s in map(list, shingle_join.shingle_sets(texts[:5]))] == [sorted(shingle_join._block([t.encode()], 5)[0]) for t in texts[:5]]


def test_embedding_links(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 16))
    rows = []
    for i in range(120):
        v = base[i % 6] + r.normal(size=16) * (0.02 if i % 2 else 0.22)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 6 == 0)))
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [], 1), (206, rows[0][1], None), (207, [1.0, None], 0)]
    got = {x.vec_id: x for x in embedding_dups.link_vectors(spark.createDataFrame([(*r_, "c", 3) for r_ in rows], "vec_id long, embedding array<float>, label int, block string, copies int"), block=16).collect()}
    ok = [(i, np.array(v, float) / np.linalg.norm(v), l_) for i, v, l_ in rows if i < 202]
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1 :] if a[2] == b[2] and a[1] @ b[1] >= 0.93]
    found = sum(x.n_links for x in got.values()) / 2
    assert 0.95 * len(links) <= found <= len(links)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(202, 208))
    assert got[200].component_id == got[201].component_id == got[0].component_id
    many = Counter(x for link in links for x in link)
    assert all(got[i].n_links <= many[i] for i in range(120))


def pivotal(items, seed, level):
    rest, out = None, {}
    for new in sorted(items):
        new = list(new)
        if rest is None:
            rest = new
            continue
        (ia, aa, va, xa), (ib, ab, vb, xb) = rest, new
        up, down = min((1 - xa) * va, xb * vb), min(xa * va, (1 - xb) * vb)
        u = int(hashlib.md5(f"{seed}|{level}|{ib}|{ab}".encode()).hexdigest()[:13], 16) / 2**52
        if u * (up + down) < down:
            first, whole_a, whole_b, na, nb = (1 - xa) * va <= xb * vb, 1, 0, xa + xb * vb / va, xb - (1 - xa) * va / vb
        else:
            first, whole_a, whole_b, na, nb = xa * va <= (1 - xb) * vb, 0, 1, xa - (1 - xb) * vb / va, xb + xa * va / vb
        if first:
            out[ia, aa], rest = whole_a, [ib, ab, vb, nb]
        else:
            out[ib, ab], rest = whole_b, [ia, aa, va, na]
    return rest, out


def test_fold_is_pivotal_rounding(spark):
    items = [(i, 0, 10 + 7 * i % 40, 0.37) for i in range(20)]
    df = spark.createDataFrame([(items,)], f"items array<{mixing.ITEM}>")
    got = df.select(mixing.fold(F.col("items"), 7, 1).alias("f")).first().f
    rest, out = pivotal(items, 7, 1)
    assert {(d.doc_id, d.again): d.more for d in got.decided} == out
    assert (got.rest.doc_id, got.rest.x) == (rest[0], pytest.approx(rest[3]))
    words_now = sum(s * out[i, a] for i, a, s, _ in items if (i, a) in out) + rest[2] * rest[3]
    assert words_now == pytest.approx(sum(s * x for _, _, s, x in items))


def test_mix(spark):
    r = random.Random(1)
    texts = ["w " * r.randrange(1, 60) for _ in range(400)] + [None, "", "w " * 5000]
    sources = [("a", "b", "c", None)[min(3, i // 130)] for i in range(403)]
    docs = docs_of(spark, texts, sources)
    got = mixing.mix(docs, fan=8).collect()
    assert len(got) == 403 and got == mixing.mix(docs, fan=8).collect() or sorted(got) == sorted(mixing.mix(docs, fan=8).collect())
    by = defaultdict(list)
    for x in got:
        by[x.source].append(x)
        assert x.taken % max(1, x.size) == 0 and 0 <= x.copies <= 3
    sizes = {s: sum(x.size for x in rows) for s, rows in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for s, rows in by.items():
        assert rows[0].target == pytest.approx(target[s]) and rows[0].source_size == sizes[s]
        assert abs(sum(x.taken for x in rows) - target[s]) <= max(x.size for x in rows)
    taken = mixing.take_mix(docs, fan=8)
    assert taken.columns == docs.columns
    assert Counter(x.doc_id for x in taken.collect()) == {x.doc_id: x.copies for x in got if x.copies}
    assert mixing.mix(docs.limit(0)).count() == 0


URLS = [None, "no scheme", "https://Example.ORG/es/x?q", "http://www.example.org/en/12#a", "http://example.org", "http://notexample.org/es/", "x://a.com/fr/1", "x://a.b.com/de/", "x://com/de/1", "x://org", "x://", "x://a.org/es/", "x://www.example.org/es/", "x://a.com/de/"]


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", None, "/"), ("block", "www.example.org", None)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS * 40)], "page_id long, url string, host string, part int")
    got = {x.page_id: x for x in url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), rows_each=50).collect()}
    assert len(got) == len(URLS) * 40
    for i, u in enumerate(URLS * 40):
        host, path = "", ""
        if u and "://" in u:
            host = u.split("://", 1)[1]
            cut = min((host.index(c) for c in "/?#" if c in host), default=len(host))
            host, path = host[:cut].lower(), host[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p or ""), len(h), f"{h}{p or ''}", v) for v, h, p in rules if h and (host == h or host.endswith(f".{h}")) and path.startswith(p or "")]
        want = max(fits)[2:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u


@pytest.mark.parametrize("file, rule", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_fast_encoding_is_exact(file, rule, corpus):
    encoder = Encoder(tokenizer_path(file), rule)
    texts = [t or "" for t in corpus[:20]] + ["a  b", " a", "a ", "a\n\nb", "x\ty", "it's we're\n'll", "İ ΑΣ ß ñandú", "日本 語\nテ", "\x1c a", "5 ́", "a.b,c 1,5. end.", "!!,. x", "\n", "ab\x01c", "naïve, café. À"]
    texts += ["hi <|endoftext|> ok", "<|startoftext|>a", "x<|endoftext|>", "<|endo", "a\u3000b", "Ünïcode. ŐK, ª.º", "a.b.c,d", "'s.x", "x" * 50 + " y." + "z" * 40]
    plain = Tokenizer.from_file(tokenizer_path(file))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1] + texts) == want[::-1] + want
    as_text = Encoder(tokenizer_path(file), rule, specials_as_text=True)
    plain.encode_special_tokens = True
    assert as_text.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] != want
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]


def test_the_table_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"), "bytes")
    texts = [" ".join(words(40, seed)) for seed in range(30)]
    for t in texts:
        assert encoder.encode([t]) == encoder.whole([t])
        assert len(encoder.kept) <= 50 + 40 and len(encoder.older) <= 50 + 40


def test_packing(spark, corpus):
    docs = docs_of(spark, corpus * 3)
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    encoder = Encoder(path, "words")
    want = []
    for i, t in enumerate(corpus * 3):
        ids = encoder.whole([t or ""])[0] + b"\0\0\0\0"
        want += [(i, k, a // 4, len(ids[a : a + 8192]) // 4, zlib.crc32(ids[a : a + 8192])) for k, a in enumerate(range(0, len(ids), 8192))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack(docs.limit(0), path).count() == 0


def test_best_two_fit_replaces_the_smallest():
    kinds = packing.bin_kinds({6: 1, 3: 1, 2: 2, 5: 1}, 10)
    assert sum(n for _, n in kinds) == 2 and all(sum(held) <= 10 for held, _ in kinds)
    counts = Counter()
    for held, n in packing.bin_kinds({i: 3 + i % 7 for i in range(1, 60)}, 64):
        counts.update({k: v * n for k, v in Counter(held).items()})
    assert counts == {i: 3 + i % 7 for i in range(1, 60)}


def test_arrow_shards(spark, corpus):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = docs_of(spark, corpus)
    folder = new_path(spark, "test-shards")
    shards = arrow_shards.write_shards(docs, folder, path, 2, length=16, rows=4)
    got = sorted(tuple(r) for r in arrow_shards.read_shards(shards).collect())
    ids = [x + b"\2\0\0\0" for x in Encoder(path, "bytes").whole([t or "" for t in corpus])]
    at, want = 0, []
    for i, x in enumerate(ids):
        want.append((i, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert got == want
    first = shards.orderBy("shard").first()
    whole = np.frombuffer(b"".join(ids), "<u4")
    shard = arrow_shards.Shard(first.path)
    tokens, bits = shard.sequence(5)
    assert (tokens == whole[80:96]).all() and shard.mask(5).all() and not tokens.flags.owndata and not bits.flags.owndata
    last = -(-first.n_tokens // 16) - 1
    assert shard.mask(last).sum() == first.n_tokens - 16 * last
    assert arrow_shards.token_files(docs.limit(0), path).count() == 0


def test_media_round_trip(spark, corpus):
    got = telephony.media_table(docs_of(spark, corpus + ["a" * 576, "\x7f\x00é"])).collect()
    for r in got:
        raw = ((corpus + ["a" * 576, "\x7f\x00é"])[r.doc_id] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = telephony.wave_file(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (0, 1)}) == 1


def test_codecs():
    mulaw, alaw = telephony.mulaw_table(), telephony.alaw_table()
    assert (mulaw[0], mulaw[0x80], mulaw[0xFF], mulaw[0x7F]) == (-32124, 32124, 0, 0)
    assert (alaw[0xD5], alaw[0x55], alaw.max(), alaw.min()) == (8, -8, 32256, -32256)
    block = bytes([16, 0, 0, 0, 0x70, 0x0F])

    def slow(block):
        value, index, out = int.from_bytes(block[:2], "little", signed=True), block[2], []
        out.append(value)
        for b in block[4:]:
            for n in (b & 15, b >> 4):
                step = int(telephony.IMA_STEPS[index])
                change = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                value = max(-32768, min(32767, value - change if n & 8 else value + change))
                index = max(0, min(88, index + int(telephony.IMA_MOVES[n & 7])))
                out.append(value)
        return out

    blocks = np.frombuffer(block + bytes([255, 127, 88, 0, 0x77, 0x77]), np.uint8).reshape(2, 6)
    assert telephony.decode_ima(blocks).tolist() == [slow(bytes(b)) for b in blocks]
    tone = (8000 * np.sin(np.arange(800) * 2 * np.pi * 440 / 8000)).astype(np.int16)
    want = 8000 * np.sin(np.arange(1600) * 2 * np.pi * 440 / 16000)
    assert np.abs(telephony.resample(tone, 8000, 16000)[50:-50] - want[50:-50]).max() < 200
    assert len(telephony.resample(tone, 8000, 11025)) == 1103


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_page_structure(spark):
    html = page('<nav>menu</nav><header>site</header><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one<br>two  <b>th</b>ree<p>four<div class="comments"><p>nice</p></div><aside>side</aside><script>x("</p>")</script></article><form>mail</form><footer>foot</footer>')
    rows = [(0, "http://a/1", html, "k"), (1, "http://a/2", html, "k"), (2, None, None, "k"), (3, "http://b/1", "", "k"), (3, "http://b/1", "", "k"), (4, "http://c", "plain &lt; text", "k")]
    got = sorted(tuple(r)[:4] for r in page_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, key string")).collect())
    text = "A & B\n\none two three\n\nfour"
    assert [(g[0], g[2], g[3]) for g in got] == [(0, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (3, "", 0), (4, "plain < text", 12)]


def test_page_differencing(spark):
    rows = [(i, f"http://h/x/{i}", page(f"<div>Our shop</div><p>Text number {i} {'long ' * i}</p><p>All prices in full</p>"), 0) for i in range(6)]
    got = {r.page_id: r.text for r in page_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, part int"), rows_each=100).collect()}
    assert got == {i: f"Text number {i} {'long ' * i}".strip() for i in range(6)}


def test_pages_of_one_host_are_read_in_parts(spark):
    rows = [(i, f"http://h/{1000 + i}", page(f"<p>Site</p><p>Text {i}</p><p>{'Odd' if i % 2 else 'Even'}</p><p>Text {i // 3}</p>"), 0) for i in range(700)]
    got = {r.page_id: r.text for r in page_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, part int"), rows_each=10_000).collect()}
    want = page_text.main_texts([page_text.lines_of(r[2]) for r in rows], 4)
    assert got == {i: t for i, (t, _) in enumerate(want)}


def texts_of_pages(spark, rows, **options):
    return {r.page_id: (r.text, r.n_shared) for r in page_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_boilerplate_heavier_than_the_text_goes(spark):
    menu = "".join(f"<p>Section {k} {'of the shop ' * 8}</p>" for k in range(20))
    rows = [(i, f"http://h/{i}", page(f"{menu}<p>Own text {i} {'word ' * 20}</p>")) for i in range(6)]
    assert {i: t for i, (t, _) in texts_of_pages(spark, rows).items()} == {i: f"Own text {i} {'word ' * 20}".strip() for i in range(6)}


def test_pages_beyond_many_copies_are_found(spark):
    story = "".join(f"<p>Paragraph {k} of the story {'tells ' * 20}</p>" for k in range(6))
    rows = [(i, f"http://h/{100 + i}", page(f"<p>Site</p>{story}<p>Seen {i if i % 2 else 0} times</p>")) for i in range(60)]
    rows += [(i, f"http://h/{100 + i}", page(f"<p>Site</p><p>Other text {i}</p>")) for i in range(60, 200)]
    got = texts_of_pages(spark, rows)
    for i in range(60):
        assert got[i][0].startswith("Paragraph 0") and got[i][0].count("Paragraph") == 6, i


def test_page_texts_do_not_depend_on_range_bounds(spark):
    story = "".join(f"<p>Paragraph {k} of the story {'tells ' * 20}</p>" for k in range(3))
    rows = [(i, f"http://{'abcdefgh'[i // 2]}.org/{i}", page(f"<p>Site {i // 2}</p><p>Text {i}</p>")) for i in range(16)]
    rows += [(i, f"http://i/{100 + i}", page(f"<p>Site</p><p>Text {i % 5}</p><p>{'Odd' if i % 2 else 'Even'}</p>")) for i in range(16, 40)]
    rows += [(i, f"http://j/{100 + i}", page("<p>Site</p><p>Not found</p>")) for i in range(40, 70)]
    rows += [(i, f"http://j/{100 + i}", page(f"<p>Site</p>{story}<p>Seen {i} times</p>")) for i in range(70, 85)]
    rows += [(i, f"http://j/{100 + i}", page(f"<p>Site</p><p>Text {i}</p>")) for i in range(85, 200)]
    got = texts_of_pages(spark, rows, rows_each=3)
    assert got == texts_of_pages(spark, rows, rows_each=10_000)
    assert [got[i][0] for i in range(16)] == [f"Text {i}" for i in range(16)] and got[40][0] == "Not found"


def test_shared_lines_of_articles_go_unless_proven(spark):
    rows = [(i, f"http://h/{i}", page(f"<main><article><h1>Same title</h1><div>Read more on our site</div><p>Own {i}</p><div>Loose {i}</div><p>Same words</p></article></main>")) for i in range(5)]
    rows += [(9, "http://alone/", rows[0][2])]
    got = texts_of_pages(spark, rows)
    assert got == {i: (f"Same title\n\nOwn {i}\n\nLoose {i}\n\nSame words", 1) for i in range(5)} | {9: ("Same title\n\nRead more on our site\n\nOwn 0\n\nLoose 0\n\nSame words", 0)}


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><p>one <svg><text>x</text></svg> two</p></article>", "one two"),
        ('<article><p>one<span class="share"> tweet </span> two</p></article>', "one two"),
        ('<article><p>one <span class="ad">buy</p><p>two</p></article>', "one\n\ntwo"),
        ('<article><div class="content with-sidebar"><p>one</p></div></article>', "one"),
        ('<article><div class="entry comments-open"><p>one</p></div><div class="comments"><p>no</p></div></article>', "one"),
        ('<article><div class="widget"><p>one</p></div></article>', "one"),
        ('<article><div class="post-comments"><p>no</p></div><p>one</p></article>', "one"),
        ('<div class="sidebar"><p>no</p></div><p>one</p>', "one"),
        ("<nav>only</nav>", ""),
        ("<article><p>a<button>b", "a"),
    ],
)
def test_marks(body, want):
    assert page_text.kept_text(page_text.lines_of(page(body)), []) == want


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_hosts_with_and_without_articles_against_brute_force(spark):
    """Lines differ within a page, so those of all other pages' texts that come in order are the longest common ones."""
    r = random.Random(12)
    rows, want = [], {}
    for i in range(60):
        host, article = "abc"[i // 20], i // 20 == 1
        site = [f"Site {host} {k}" for k in range(4)]
        own = [f"Own {i} {k} {r.random()}" for k in range(r.randrange(3, 6))]
        lines = [*site[:2], *own, *site[2:]]
        body = "".join(f"<div>{x}</div>" for x in lines)
        rows.append((i, f"http://{host}.org/{100 + i}", page(f"<article>{body}<p>{site[0]}</p></article>" if article else body)))
        want[i] = (lines + [site[0]] if article else lines, own + [site[0]] if article else own)
    for rows_each in (1, 7, 1000):
        got = texts_of_pages(spark, rows, rows_each=rows_each)
        for i, (lines, text) in want.items():
            j = i + 1 if i % 20 == 0 else i - 1
            assert got[i] == ("\n\n".join(text), longest_common(lines, want[j][0]) - (20 <= i < 40)), (rows_each, i)
    joined = texts_of_pages(spark, rows, broadcast_bytes=0)
    assert joined == got
    assert texts_of_pages(spark, [], rows_each=1) == {}


def test_very_long_pages_and_repeated_rows(spark):
    long = "".join(f"<div>Line {k}</div>" for k in range(5000))
    rows = [(1, "http://h/1", page(f"<div>Site</div>{long}")), (2, "http://h/2", page("<div>Site</div><div>Two</div>"))] * 2
    got = sorted(tuple(r)[:3] for r in page_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "http://h/1", "\n\n".join(f"Line {k}" for k in range(5000)))] * 2 + [(2, "http://h/2", "Two")] * 2


def test_common_lines_like_dynamic_programming():
    r = random.Random(3)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = page_text.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(got)


def test_common_lines_of_many_equal_pairs():
    one, other = ["x"] * 1500 + ["s"] + ["x"] * 1500, ["x"] * 100 + ["s"] + ["x"] * 1500
    got = page_text.common_lines(one, other)
    assert len(got) == 1601 and 1500 in got
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(20))] for _ in range(2))
        got = page_text.common_lines(a, b, 3)
        rest = iter(b)
        assert len(got) == len(page_text.common_lines(a, b)) and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_toxicity(spark):
    r = random.Random(8)
    plain = ["the", "river", "house", "green", "walks", "under", "light", "stone", "table", "morning"]
    texts, labels = [], []
    for i in range(300):
        w = [r.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            for bad in r.sample(["idiot", "moron", "stupid"], 2):
                w.insert(r.randrange(30), bad)
        texts.append(" ".join(w))
        labels.append((i, int(i % 3 == 0), None))
    odd = ["you m0r0n and st.u.p.i.d i d i o t", None, "", "the river house walks"]
    docs = docs_of(spark, texts + odd)
    known = spark.createDataFrame(labels + [(0, None, None), (None, 1, None)], "doc_id long, toxic int, text string")
    got = {x.doc_id: x for x in toxicity.score_documents(docs, known).collect()}
    assert len(got) == 304 and got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[300].predicted == 1 and got[301].predicted == got[302].predicted == got[303].predicted == 0
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.predicted}
    assert {x.score for x in toxicity.score_documents(docs, known.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), known).count() == 0


DISGUISED = ["a$$", "4$$", "455", "f***", "!diot", "(rap", "stu-pid", "st.u.p.i.d", "stuupid", "st upid", "st up id", "іdiot", "ｉｄｉｏｔ", "ІDIОT", "ïdíöt", "id*ot", "i d i o t", "st-upid", "f o o l"]


def test_each_disguise_is_found(spark):
    r = random.Random(8)
    plain = ["the", "river", "house", "green", "walks", "under", "light", "stone", "table", "morning"]
    toxic = ["idiot", "stupid", "ass", "fool", "crap"]
    texts = [" ".join([r.choice(plain) for _ in range(30)] + (r.sample(toxic, 3) * 8 if i % 3 == 0 else [])) for i in range(300)]
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), known)
    assert {x for x in DISGUISED if not model.hits([f"the river {x} house"])[0]} == set()
    assert model.hits(["the river house under 12 light, morning!", ""]) == [{}, {}]


def grams_of(text):
    s = [0, *toxicity._symbols[np.frombuffer(text.encode(), np.uint8)].tolist(), 0]
    return Counter((a * toxicity.SIGNS + b) * toxicity.SIGNS + c for a, b, c in zip(s, s[1:], s[2:], strict=False))


def test_long_pieces_are_decoded_whole():
    decoder = toxicity.Decoder(grams_of(" ".join(["moron idiot loser stupid the house was red"] * 5)))
    for n in (30, 36, 37, 38):
        assert decoder.decode("." * n + "m0r0n") == "moron", n
    assert decoder.decode("s**p*d") == "stupid"
    long = "m0r0n.st*pid-l0$er " * 700
    whole = decoder.decode(long)
    assert whole.replace(" ", "") == "moronstupidloser" * 700
    held, toxicity.STEPS_HELD = toxicity.STEPS_HELD, 50
    try:
        assert decoder.decode(long) == whole
    finally:
        toxicity.STEPS_HELD = held
    assert decoder.decode_all([]) == [] and decoder.decode_all(["", "***", "m0r0n"]) == ["", decoder.decode("***"), "moron"]


def cheapest_path(decoder, raw):
    """By trying all paths of the lattice."""
    paths = [((0, 0), 0.0, "")]
    for i, c in enumerate(raw):
        same = i > 0 and raw[i - 1] == c
        new = []
        for (a, b), cost, said in paths:
            for code, price in toxicity.edges(c, same, same and 3 * c in raw[max(0, i - 2) : i + 2]):
                if code < 0 or code == 0 and b == 0:
                    new.append(((a, b), cost + price, said))
                else:
                    new.append(((b, code), cost + price + decoder.steps[a * toxicity.SIGNS + b, code], said + toxicity.LETTERS[code]))
        paths = new
    return min((cost + decoder.ends[a * toxicity.SIGNS + b], said) for (a, b), cost, said in paths)[1].strip()


def test_viterbi_finds_the_cheapest_path_of_all():
    decoder = toxicity.Decoder(grams_of(" ".join(["moron idiot loser stupid the house was red all too"] * 5)))
    r = random.Random(6)
    raws = ["".join(r.choice("aelost001!$.- tt*éх") for _ in range(r.randrange(1, 7))) for _ in range(300)] + ["looool", "sss", "0000", "a**", "*", "é*0"]
    assert decoder.decode_all(raws) == [cheapest_path(decoder, x) for x in raws]


@pytest.mark.parametrize("raw, want", [("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("$tupid", "stupid")])
def test_viterbi(raw, want):
    text = " ".join(["moron idiot loser stupid the house was red"] * 5)
    s = [0, *toxicity._symbols[np.frombuffer(text.encode(), np.uint8)].tolist(), 0]
    grams = Counter((a * toxicity.SIGNS + b) * toxicity.SIGNS + c for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert toxicity.Decoder(grams).decode(raw) == want


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [f"Copyright (c) 2020 Someone\n\n{mit}", mit.upper().replace("SUBLICENSE", "sub-license").replace("\n", "\n\n# "), f"{mit} and more", None, "", licenses.KNOWN["ISC"].replace("notice", "NOTICE")]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "ISC"}
    assert licenses.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


def test_titles_and_wrapped_lines_of_licenses(spark):
    bsd = licenses.KNOWN["BSD-3-Clause"]
    wrapped = bsd.replace("above copyright notice", "above\ncopyright notice").replace("THE COPYRIGHT HOLDER", "THE\nCOPYRIGHT HOLDER")
    texts = [f"MIT License\n\nCopyright (c) 2020 Someone\n\n{licenses.KNOWN['MIT']}", f"BSD 3-Clause License\n\nCopyright Some One\nAll rights reserved.\n\n{wrapped}", licenses.KNOWN["Unlicense"], wrapped]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "BSD-3-Clause", 2: "Unlicense", 3: "BSD-3-Clause"}


def layouts():
    """Known licences as files have them: under a title and copyright lines, as a comment, in capitals, wrapped, longer."""
    out = []
    for name, body in sorted(licenses.KNOWN.items()):
        out.append(f"{licenses.TITLES[name][0]}\n\nCopyright (c) 1999-2024, Some One <one@example.org>\nAll rights reserved.\n\n{body}\n")
        out.append("\n".join(f" * {line}" for line in f"Copyright 2001 by Some One\n\n{body}".split("\n")))
        out.append(body.upper().replace('"', "\u201c"))
        out.append(textwrap.fill(body, 40))
        out.append(body + " More.")
    return out


def test_common_layouts_of_licenses(spark):
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, layouts())).collect()}
    want = [name if k < 4 else None for name in sorted(licenses.KNOWN) for k in range(5)]
    assert [got[i] for i in range(len(want))] == want
    marked = licenses.KNOWN["BSD-2-Clause"]
    texts = [marked.replace("\n1. ", "\n(1) ").replace("\n2. ", "\n  b) "), marked.replace("\n1. ", "\n* ").replace("\n2. ", "\n* "), "  ".join(marked.split()), f"x{marked}", "l'été © 2001", marked * 2]
    docs = docs_of(spark, texts)
    assert [r.license for r in licenses.scan_licenses(docs.union(docs)).orderBy("doc_id").collect()] == ["BSD-2-Clause"] * 6 + [None] * 6


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files")
def test_digests_of_long_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [open(f"{COMMON}/{f}").read() for f in names]
    texts += [textwrap.fill(texts[0], 60), texts[2].upper(), f"{texts[1]} x"]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(7)] == list(names.values()) and got[9] is None


def test_saved_reads_again(spark):
    assert sorted(r.id for r in saved(spark.range(3), "x").collect()) == [0, 1, 2]
