"""N-gram Jaccard join with adaptive multi-match prefixes: exact links and their connected components.

A document's set is its distinct shingles of five words (A-Z in lower case), as 64-bit hashes. Sets of sizes m and n link
when 100 * intersection >= 75 * union, which needs an intersection of at least t * max(m, n). Put all shingles in one order,
the rarest first: then the first n - ceil(t n) + k shingles of both documents share at least k (the k-prefix filter). Each
document picks the k whose prefix is cheapest: the rows that its prefix costs plus the candidates to verify, estimated from
how many documents each of its shingles is in, as a longer prefix must be matched more often. A pair goes by the smaller k
of the two: of the shingles in both documents' k-prefixes it must share at least k; only then is it verified.

Steps, none of which collects documents or pairs to the driver or caps a list:

1. Equal texts become one representative (the smallest id), before anything is compared.
2. Shingles are dealt by hash to buckets, as binary blocks of one batch of documents and bucket each, where their document
   counts are found. Those in HOT_FLOOR documents or more (or in a millionth part of the corpus's shingles, if that is more,
   so that there are at most about a million of them) are counted before, over all documents, and stay with these, so no
   bucket grows with one shingle: first all shingles in cells, about two for each that may be hot, then those of full cells
   one by one. A shingle of one document can't match: a document with as many of these as its prefix is long has no
   partner and goes. Others keep the shingles with counts over 1 alone, which is all that order, prefix and intersection need.
3. Documents that share a min-hash are verified against the one among them with the fewest shingles of its own, the most
   central one: rows in proportion to documents, which ties most groups of near copies together. Components follow.
4. Prefixes are joined, but only across components, as links inside one change nothing, and where the shingles that a
   document shares with any other could be enough; shingles whose documents are all in one component go before the join. So a group of near copies, however large, makes no
   pairs. The rows of a shingle of many components are cut into blocks, and each pair of blocks is a group of its own.
5. Pairs whose prefixes match often enough are verified on the kept shingles; links of both kinds give the components.

Null, empty and wordless texts have no shingles and link with nothing; with fewer than five words the whole sequence is
the one shingle. Repeated rows and equal texts link. Very long texts are hashed in parts. An empty table gives no rows.
Columns other than the id and the text are not read. Rows with one id and different texts are each compared; a row's
component is that of its own text. Rows with a null id take part in no link and have a null component; their size is that
of an equal text with an id, or 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import components, saved, ship, text_of, trim_worker, worker_cache

#: Shingles of its prefix that each row carries.
HEAD = 24
PAIR = np.dtype([("shingle", "<u8"), ("documents", "<u4")])
#: Documents of a shingle, at least, from which on it stays with them; hot ones, about, at most; cells that travel together.
HOT_FLOOR, MOST_HOT, CELLS = 2048, 1 << 20, 1 << 14
#: Prefix rows of one shingle that are compared at once.
CROSS_BLOCK = 1024
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_codes = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(26):
    _codes[65 + _c] = _codes[97 + _c]
for _c in range(0x09, 0x0E):
    _codes[_c] = _codes[0x20]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i, modulo 2 ** 64, for i below n. The usual number is kept in the worker."""
    if n <= 2 * BLOCK:
        ups, downs = worker_cache("shingles", ("powers",), lambda: made_powers(2 * BLOCK))
        return ups[:n], downs[:n]
    return made_powers(n)


def made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ups, downs = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, by differences of one running polynomial over all bytes of a block.
    A hash depends on its words alone, so long texts go in parts that overlap by all but one word of a shingle."""
    raw = [t.encode() for t in texts]
    out: list[np.ndarray | None] = [None] * len(raw)
    short = [i for i, x in enumerate(raw) if len(x) <= BLOCK]
    for i in set(range(len(raw))) - set(short):
        out[i] = _long(raw[i], words)
    at = 0
    while at < len(short):
        n, to = 0, at
        while to < len(short) and (to == at or n + len(raw[short[to]]) < BLOCK):
            n += len(raw[short[to]]) + 1
            to += 1
        for i, found in zip(short[at:to], _block([raw[i] for i in short[at:to]], words), strict=True):
            out[i] = found
        at = to
    return out


def _long(raw: bytes, words: int) -> np.ndarray:
    """A word that is longer than a block counts by its digest."""
    own = [w if len(w) <= BLOCK else b"\0" + hashlib.blake2b(w.lower()).hexdigest().encode() for w in raw.split()]
    if len(own) < words:
        return _block([b" ".join(own)], words)[0]
    found, part, n = [], [], 0
    for i, w in enumerate(own):
        part.append(w)
        n += len(w) + 1
        if n > BLOCK and len(part) >= words or i == len(own) - 1:
            if len(part) >= words:
                found += _block([b" ".join(part)], words)
            part = part[len(part) - words + 1 :]
            n = sum(map(len, part)) + len(part)
    return np.unique(np.concatenate(found))


def _block(raw: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    space = _space[data]
    kept = ~space
    kept[1:] |= ~space[:-1]  # a word's letters, and one space after it
    letters = kept & ~space
    first = letters.copy()
    first[1:] &= space[:-1]
    place = np.cumsum(kept) - 1  # in the text without other spaces
    starts = place[np.flatnonzero(first)]
    owner = np.searchsorted(ends, np.flatnonzero(first), side="right")
    size = int(place[-1]) + 1 if len(place) else 0
    up, down = powers(size + 1)
    running = np.zeros(size + 1, np.uint64)
    np.cumsum(_codes[data[kept]] * up[:size], dtype=np.uint64, out=running[1:])
    stops = np.append(starts[1:], size)  # with the space after the word
    first_word = np.searchsorted(owner, np.arange(len(raw) + 1))
    out = []
    n = len(starts)
    full = np.arange(max(0, n - words + 1))
    whole = mixed((running[stops[full + words - 1]] - running[starts[full]]) * down[starts[full]]) if len(full) else np.zeros(0, np.uint64)
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            out.append(mixed((running[stops[b - 1] : stops[b - 1] + 1] - running[starts[a]]) * down[starts[a]]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def deal(doc_ids: list[int], sets: list[np.ndarray], buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, docs, sizes, counts, shingles, hots, hot): the shingles of some documents by hash. Each document has a
    home, by its id, with its size negative and, in place of shingles, those that are in hot (PAIR, with their documents)."""
    pairs = [(i, s) for i, s in zip(doc_ids, sets, strict=True) if len(s)]
    if not pairs:
        return
    ids, sets = np.array([i for i, _ in pairs], np.int64), [s for _, s in pairs]
    sizes = np.array([len(s) for s in sets], np.int32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    place = np.minimum(np.searchsorted(hot["shingle"], flat), max(0, len(hot) - 1))
    is_hot = hot["shingle"][place] == flat if len(hot) else np.zeros(len(flat), bool)
    held, many = hot[place[is_hot]], np.bincount(owner[is_hot], minlength=len(ids)).astype(np.int32)
    cuts = np.append(0, np.cumsum(many))
    home = (mixed(ids.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets
    for b in np.unique(home).tolist():
        who = np.flatnonzero(home == b)
        yield b, ids[who].tobytes(), (-sizes[who]).tobytes(), np.zeros(len(who), np.int32).tobytes(), b"", many[who].tobytes(), b"".join(held[cuts[i] : cuts[i + 1]].tobytes() for i in who)
    flat, owner = flat[~is_hot], owner[~is_hot]
    bucket = (flat >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket * len(sets) + owner, kind="stable")
    flat, owner, bucket = flat[order], owner[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(flat)], strict=True):
        if a < b:
            who, n = np.unique(owner[a:b], return_counts=True)
            yield int(bucket[a]), ids[who].tobytes(), sizes[who].tobytes(), n.astype(np.int32).tobytes(), flat[a:b].tobytes(), b"", b""


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: rows (doc_id, n, home, some) of documents with shingles that more than one document has, with the counts
    of their documents, and of those whose home this bucket is."""
    ids, sizes, counts = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("docs", "<i8"), ("sizes", "<i4"), ("counts", "<i4")))
    hots = np.frombuffer(b"".join(h or bytes(len(d) // 2) for h, d in zip(pdf["hots"], pdf["docs"], strict=True)), "<i4")
    flat, hot = np.frombuffer(b"".join(pdf["shingles"]), "<u8"), np.frombuffer(b"".join(pdf["hot"]), PAIR)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(flat)])
    many = np.diff(np.append(at, len(flat)))
    documents = np.empty(len(flat), np.int64)
    documents[order] = np.repeat(many, many)
    shared = documents > 1
    owner = np.repeat(np.arange(len(ids)), counts)[shared]
    pairs = np.empty(len(owner), PAIR)
    pairs["shingle"], pairs["documents"] = flat[shared], np.minimum(documents[shared], (1 << 32) - 1)
    cuts, hot_cuts = np.searchsorted(owner, np.arange(len(ids) + 1)), np.append(0, np.cumsum(hots))
    rows = np.flatnonzero((np.diff(cuts) > 0) | (sizes < 0))
    some = [pairs[a:b].tobytes() if n > 0 else hot[c:d].tobytes() for n, a, b, c, d in zip(sizes[rows], cuts[rows], cuts[rows + 1], hot_cuts[rows], hot_cuts[rows + 1], strict=True)]
    return pd.DataFrame({"doc_id": ids[rows], "n": np.abs(sizes[rows]).astype(np.int64), "home": sizes[rows] < 0, "some": some})


def hot_shingles(docs: DataFrame, n: int, words: int, cells: int, share: float) -> np.ndarray:
    """PAIRs, sorted: all shingles that at least ``share`` of the n documents have, with their documents, each document
    counted. There are no more of them than the mean size of a set / share. Shingles are counted by cells first, those of
    cells with enough documents one by one."""
    least = max(2, int(np.ceil(share * n - 1e-6)))
    if n < least:
        return np.empty(0, PAIR)
    texts = docs.select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        trim_worker()
        for batch in batches:
            for at in range(0, len(batch), 2000):
                yield np.concatenate(shingle_sets(batch["text"].iloc[at : at + 2000].tolist(), words))

    def in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = np.zeros(cells, np.uint32)
        for flat in sets(batches):
            where, some = np.unique(cell_of(flat, cells), return_counts=True)
            many[where] += some.astype(np.uint32)
        for at in range(0, cells, CELLS):
            if many[at : at + CELLS].any():
                yield pd.DataFrame({"at": [at], "many": [many[at : at + CELLS].tobytes()]})

    def full(part: pd.DataFrame) -> pd.DataFrame:
        many = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in part["many"])
        return pd.DataFrame({"cell": part["at"].iloc[0] + np.flatnonzero(many >= least)})

    found = texts.mapInPandas(in_cells, "at long, many binary").groupBy("at").applyInPandas(full, "cell long").toPandas()
    if not len(found):
        return np.empty(0, PAIR)
    may = np.zeros(cells, bool)
    may[found["cell"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(may))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = np.unpackbits(sent.value, count=cells).astype(bool)
        for flat in sets(batches):
            flat, many = np.unique(flat[may[cell_of(flat, cells)]], return_counts=True)
            yield pd.DataFrame({"shingle": flat.view(np.int64), "n": many.astype(np.int64)})

    found = texts.mapInPandas(alone, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    out = np.empty(len(found), PAIR)
    out["shingle"] = found["shingle"].to_numpy(np.int64).view(np.uint64)
    out["documents"] = np.minimum(found["n"].to_numpy(np.int64), (1 << 32) - 1)
    return out[np.argsort(out["shingle"])]


def cell_of(shingles: np.ndarray, cells: int) -> np.ndarray:
    return ((shingles >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)


def needed(n: int, percent: int) -> int:
    """The least intersection of a set of n with any it links to."""
    return -(-percent * n // 100)


def prefix_depth(documents: np.ndarray, short: int, most: int, verify: float = 8.0) -> int:
    """The k whose k-prefix is cheapest. documents: counts of the kept shingles in order; short: how many of them the
    1-prefix has. Rows cost 1 each; about rows / k candidates are verified."""
    depth = min(most, len(documents) - short + 1)
    rows = np.cumsum(documents.astype(np.float64))[short - 1 : short - 1 + depth]
    return int((rows * (1 + verify / np.arange(1, len(rows) + 1))).argmin()) + 1


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """Returns doc_id, n_shingles and component_id, a row for each row of docs. Options are those of ``linked``."""
    return linked(docs, **options)[0].select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, percent: int = 75, words: int = 5, most_depth: int = 16, hashes: int = 3, shingles_each: int = 1 << 20, hot_sample: int | None = None, hot_share: float | None = None, broadcast_ids: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, bool]:
    """doc_id, mark (of the text), n_shingles, component_id and part (equal within a component), a row for each row of docs;
    and whether some id may have several texts. Hot shingles are counted in all documents; hot_sample, which once told how many
    to estimate them from, is still taken and not used."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    marks = saved(own.select("doc_id", F.md5("text").alias("mark"), F.length("text").cast("long").alias("length")), "marks")
    firsts = saved(marks.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("length").alias("length")), "firsts")
    n_marks, text_length = firsts.agg(F.count("*"), F.sum("length")).first()
    n_shingles = (text_length or 0) // 6  # about
    buckets = max(128, -(-n_shingles // shingles_each))
    most = max(HOT_FLOOR, n_shingles // MOST_HOT)
    cells = 1 << max(10, (2 * n_shingles // most).bit_length())
    hot_share = hot_share or most / max(1, n_marks)

    # Rows that are not their group's representative go before any text is dealt.
    extra = saved(marks.join(firsts.where("copies > 1"), "mark").where("doc_id > rep").select("doc_id").distinct(), "copies")
    n_extra, (n_rows, n_ids) = extra.count(), marks.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    kept = own.join(F.broadcast(extra) if n_extra <= broadcast_ids else extra, "doc_id", "left_anti") if n_extra else own
    firsts, torn = firsts.withColumn("node", F.col("rep")), n_rows > n_ids
    if torn:
        # Texts whose smallest id has other texts too get a number of their own, below all ids.
        many = marks.groupBy("doc_id").agg(F.count_distinct("mark").alias("texts")).where("texts > 1")
        part = F.conv(F.substring("mark", 1, 3), 16, 10).cast("long")
        place = F.row_number().over(Window.partitionBy(part).orderBy("mark"))
        own_node = saved(firsts.join(many, firsts["rep"] == many["doc_id"], "left_semi").select("mark", "rep", (F.lit(-(1 << 62)) - place * 4096 - part).alias("own")), "torn")
        firsts = saved(firsts.join(own_node.select("mark", "own"), "mark", "left").select("mark", "rep", "copies", "length", F.coalesce("own", "node").alias("node")), "nodes")
        ids = own_node.select(F.col("rep").alias("doc_id")).distinct()
        loose = own.join(ids, "doc_id", "left_semi").withColumn("mark", F.md5("text"))
        loose = loose.join(own_node, (loose["mark"] == own_node["mark"]) & (F.col("doc_id") == F.col("rep"))).select(F.col("own").alias("doc_id"), "text")
        kept = kept.join(ids, "doc_id", "left_anti").union(loose).dropDuplicates(["doc_id"])
    kept = kept.where("doc_id is not null")  # before pandas, which would make other ids floating
    hot = spark.sparkContext.broadcast(hot_shingles(kept, n_marks, words, cells, hot_share))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim_worker()
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                sets = shingle_sets(part["text"].tolist(), words)
                yield pd.DataFrame(list(deal(part["doc_id"].astype(np.int64).tolist(), sets, buckets, hot.value)), columns=["bucket", "docs", "sizes", "counts", "shingles", "hots", "hot"])

    dealt = kept.mapInPandas(cut, "bucket long, docs binary, sizes binary, counts binary, shingles binary, hots binary, hot binary")
    dealt = dealt.repartition(buckets, "bucket")  # tasks of one size, however large the table
    some = saved(dealt.groupBy("bucket").applyInPandas(counted, "doc_id long, n long, home boolean, some binary"), "counted")
    sizes = some.where("home").select(F.col("doc_id").alias("rep"), "n")
    some = some.where("length(some) > 0").groupBy("doc_id").agg(F.max("n").alias("n"), F.collect_list("some").alias("some"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim_worker()
        for batch in batches:
            out = []
            for doc_id, n, parts in zip(batch["doc_id"].tolist(), batch["n"].tolist(), batch["some"], strict=True):
                held = np.frombuffer(b"".join(parts), PAIR)
                single = n - len(held)
                short = n - needed(n, percent) + 1 - single  # shingles with partners in the 1-prefix
                if short < 1:
                    continue
                held = held[np.lexsort((held["shingle"], held["documents"]))]
                depth = prefix_depth(held["documents"], short, most_depth)
                mins = [int(mixed(held["shingle"] ^ np.uint64(j + 1)).min() >> np.uint64(1)) for j in range(hashes)]
                out.append((doc_id, n, len(held), short, depth, held["shingle"].tobytes(), mins))
            yield pd.DataFrame(out, columns=["doc_id", "n", "common", "short", "depth", "shingles", "mins"])

    left = saved(some.mapInPandas(keep, "doc_id long, n long, common long, short int, depth int, shingles binary, mins array<long>"), "kept")

    # Against the document with the fewest shingles of its own of each min-hash.
    named = left.select("doc_id", (F.col("n") - F.col("common")).alias("own"), F.posexplode("mins").alias("j", "min"))
    leaders = saved(named.groupBy("j", "min").agg(F.min_by("doc_id", F.struct("own", "doc_id")).alias("leader"), F.count("*").alias("many")).where("many > 1").drop("many"), "leaders")
    own = saved(named.join(leaders, ["j", "min"]).select("doc_id", "j", "leader"), "own-leaders")
    tied = own.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = saved(measured(saved(tied, "tied"), left, percent), "near")
    links = near.where("linked").select("a", "b")
    parts = components(links, "a", "b")
    told = own.join(near.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), "shared"), ["leader", "doc_id"], "left")
    told = told.groupBy("doc_id").agg(*(f(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for c, f in (("leader", F.max), ("shared", F.max)) for j in range(hashes)))
    placed = left.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(told, "doc_id", "left")
    # Without a leader a document is its own, with all its shingles.
    placed = placed.withColumns({"component": F.coalesce("component", "doc_id")} | {f"leader{j}": F.coalesce(f"leader{j}", "doc_id") for j in range(hashes)} | {f"shared{j}": F.coalesce(f"shared{j}", "common") for j in range(hashes)})
    ties = [f"{c}{j}" for c in ("leader", "shared") for j in range(hashes)]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim_worker()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                shingles = [np.frombuffer(x, "<i8") for x in part["shingles"]]
                ends = [min(len(s), short + depth - 1) for s, short, depth in zip(shingles, part["short"], part["depth"], strict=True)]
                taken = [s[:e] for s, e in zip(shingles, ends, strict=True)]
                level = [np.maximum(1, np.arange(e) - (short - 1) + 1) for e, short in zip(ends, part["short"], strict=True)]
                heads = [np.resize(t, HEAD).astype("<i8").tobytes() for t in taken]
                if taken:
                    yield pd.DataFrame({"shingle": np.concatenate(taken), "level": np.concatenate(level).astype(np.int32), "place": np.concatenate([np.arange(e, dtype=np.int32) for e in ends]), "head": np.repeat(np.array(heads, object), ends), **{c: np.repeat(part[c].to_numpy(), ends) for c in ("doc_id", "component", "n", "common", "depth", *ties)}})

    ahead = placed.select("doc_id", "component", "n", "common", "short", "depth", "shingles", *ties).mapInPandas(prefixes, "shingle long, level int, place int, head binary, doc_id long, component long, n long, common long, depth int, " + ", ".join(f"{t} long" for t in ties))
    ahead = saved(ahead, "prefixes")
    across = ahead.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x <> y").select("shingle", F.ceil(F.col("many") / CROSS_BLOCK).cast("int").alias("blocks"))
    ahead = ahead.join(saved(across, "across"), "shingle")
    # A row meets its own block's rows, and those of each other block of its shingle in a group of the two.
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    ahead = ahead.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    ahead = ahead.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead = ahead.repartition(tasks, "shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "component", "doc_id")
    met = ahead.mapInPandas(lambda batches: crossing(batches, percent, hashes), "a long, b long")
    pairs = met.distinct()
    links = links.union(measured(saved(pairs, "candidates"), left, percent, True).where("linked").select("a", "b"))
    parts = components(links, "a", "b")
    known = firsts.select("mark", "rep", "node").join(sizes.withColumnRenamed("rep", "node"), "node", "left").join(parts, "node", "left")
    known = saved(known.select("mark", "rep", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("component", "node").alias("part")), "known")
    known = known.withColumn("component", F.col("part"))
    if torn:  # parts are called by their smallest node; what counts is the smallest id
        known = known.join(known.groupBy("part").agg(F.min("rep").alias("least")), "part", "left").withColumn("component", F.col("least"))
    out = marks.join(known.select("mark", "n", "part", "component"), "mark")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), "part"), torn


#: What the rows of ``crossing`` that meet have in common.
GROUP = ("shingle", "low", "high")


def crossing(batches: Iterator[pd.DataFrame], percent: int, hashes: int) -> Iterator[pd.DataFrame]:
    """Over rows sorted by shingle, pair of blocks and component: the pairs of documents of different components that share a shingle in
    both's prefixes of the smaller depth, if they can link: what they share is bounded by how many of their shingles other
    documents have too, and, beside the same leader, by what one shares with it and what the other has beyond it. A pair
    that the first shingles of both, which each row carries, show to meet at an earlier shingle is left to that one."""
    trim_worker()
    held: list[pd.DataFrame] = []

    def pairs(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = [part[c].to_numpy() for c in GROUP]
        block, between = part["block"].to_numpy(), keys[1] != keys[2]
        doc, comp, n, common, level, depth, place = (part[c].to_numpy() for c in ("doc_id", "component", "n", "common", "level", "depth", "place"))
        head = np.frombuffer(b"".join(part["head"]), "<i8").reshape(-1, HEAD)
        ties = [(part[f"leader{j}"].to_numpy(), part[f"shared{j}"].to_numpy()) for j in range(hashes)]
        new_shingle = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        new_comp = new_shingle | np.append(True, comp[1:] != comp[:-1])
        # Each row meets all rows of its group that come after its own component, and of two blocks the other one's.
        ends = np.append(np.flatnonzero(new_shingle)[1:], len(part))[np.cumsum(new_shingle) - 1]
        own_end = np.append(np.flatnonzero(new_comp)[1:], len(part))[np.cumsum(new_comp) - 1]
        many = ends - own_end
        for at in _chunks(many, 1 << 19):
            rows = np.repeat(np.arange(at.start, at.stop), many[at])
            starts = np.repeat(own_end[at] - np.append(0, np.cumsum(many[at])[:-1]), many[at])
            others = starts + np.arange(len(rows))
            apart = ~between[rows] | (block[rows] != block[others])
            rows, others = rows[apart], others[apart]
            most = np.minimum(common[rows], common[others])
            for leader, shared in ties:
                beside = np.minimum(shared[rows] + common[others] - shared[others], shared[others] + common[rows] - shared[rows])
                most = np.where(leader[rows] == leader[others], np.minimum(most, beside), most)
            fits = 100 * most >= percent * (n[rows] + n[others] - most)
            rows, others = rows[fits], others[fits]
            inside = np.maximum(level[rows], level[others]) <= np.minimum(depth[rows], depth[others])
            rows, others = rows[inside], others[inside]
            met = np.zeros(len(rows), bool)
            for i in range(HEAD):
                for j in range(HEAD):
                    met |= (head[rows, i] == head[others, j]) & (i < place[rows]) & (j < place[others])
            rows, others = rows[~met], others[~met]
            if len(rows):
                yield pd.DataFrame({"a": np.minimum(doc[rows], doc[others]), "b": np.maximum(doc[rows], doc[others])}).drop_duplicates()

    for batch in batches:
        if not len(batch):
            continue
        tail = np.all([batch[c].to_numpy() == batch[c].iloc[-1] for c in GROUP], axis=0)
        if tail.all():
            held.append(batch)
            continue
        yield from pairs(pd.concat([*held, batch[~tail]], ignore_index=True))
        held = [batch[tail]]
    if held:
        yield from pairs(pd.concat(held, ignore_index=True))


def _chunks(many: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows with about ``most`` partners together."""
    if not len(many):
        return
    run = np.cumsum(many) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(many)], strict=True):
        yield slice(a, b)


def measured(pairs: DataFrame, sets: DataFrame, percent: int, prefixed: bool = False) -> DataFrame:
    """pairs (a, b) with shared and linked, by the whole sets: shingles that were dropped are in one document only. With
    prefixed, pairs whose prefixes of the smaller depth k share fewer than k are told unlinked without that."""
    side = lambda s: sets.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "short", "depth", "shingles")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim_worker()
        for batch in batches:
            shared = []
            for x, y, short_x, short_y, k_x, k_y in zip(*(batch[c] for c in ("shingles_a", "shingles_b", "short_a", "short_b", "depth_a", "depth_b")), strict=True):
                one, two, k = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), min(k_x, k_y)
                if prefixed and k > 1 and len(np.intersect1d(one[: short_x + k - 1], two[: short_y + k - 1], assume_unique=True)) < k:
                    shared.append(0)
                else:
                    shared.append(len(np.intersect1d(one, two, assume_unique=True)))
            counts = np.array(shared, np.int64)
            yield batch[["a", "b"]].assign(shared=counts, linked=100 * counts >= percent * (batch["n_a"] + batch["n_b"] - counts))

    return both.mapInPandas(check, "a long, b long, shared long, linked boolean")


def keep_one_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, of repeated rows one. Rows with a null id
    all stay."""
    found, torn = linked(docs, id_column=id_column, text_column=text_column, **options)
    nameless = docs.where(F.col(id_column).isNull())
    if not torn:
        drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
        rest = docs.join(drop, id_column, "left_anti").select(*docs.columns)
        return rest.where(F.col(id_column).isNotNull()).dropDuplicates([id_column]).union(nameless)
    # Rows without shingles link with nothing; each text of an id stays once.
    alone = F.when(F.col("n_shingles") > 0, F.col("part").cast("string")).otherwise(F.concat_ws("|", F.lit("alone"), "doc_id", "mark"))
    stay = found.where("doc_id is not null").groupBy(alone.alias("part")).agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*")
    place = F.row_number().over(Window.partitionBy(F.col(id_column).cast("long"), F.md5(text_of(text_column))).orderBy(F.lit(0)))
    named = docs.where(F.col(id_column).isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_column).cast("long").alias("k_id"), F.md5(text_of(text_column)).alias("k_mark"), place.alias("k_place"))
    rest = named.where("k_place = 1").join(stay, (F.col("k_id") == stay["doc_id"]) & (F.col("k_mark") == stay["mark"]), "left_semi")
    return rest.select("row.*").union(nameless)


def exact_jaccard_links(texts: dict[int, str], percent: int = 75, words: int = 5) -> set[tuple[int, int]]:
    """All linked pairs, by comparing all: for small tables and tests."""
    sets = {}
    for k, t in texts.items():
        w = [x.lower() for x in (t or "").encode().split()]
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}

