"""Alignment of two tokenizers' tokens by the bytes that they cover, with corpus-wide counts of linked ids.

The tables are those of a relational alignment: tokens with cumulative byte lengths, an equi-join of both sides on text and
end, running counts of common ends as group numbers, and the pairs of tokens whose byte ranges meet. `align_rows` is that
plan in rows of Spark, from posexplode to joins. A corpus has some 80 tokens to 100 characters, though, and every row of
theirs is sorted and shuffled several times there (README has the figures), so `align` keeps the token tables of a batch of
texts as columns where the texts are read, and joins these:

1. Both tokenizers cut before a blank or line feed between two signs that aren't white space, whatever follows or precedes.
   Each different piece between such cuts is encoded and aligned once in a batch; its tokens' ends and groups are columns of
   numbers, joined by sorted search. Texts with other white space are cut only between letters and signs of Latin script,
   and what has no certain cut is a piece, however long.
2. Each text gets its numbers, the digest of its groups, and its distinct linked id pairs with how often they occur.
3. The pairs are exploded and counted in Spark: documents that hold a pair, and the highest count of each id of A. Counts
   come back to the documents by a join on the pair: the most frequent pairs, at most HOT of them, are broadcast, the rest is
   dealt by pair.

Every row of docs is a document, repeated ones too. Null and empty texts, and texts that one of the tokenizers doesn't give
back byte for byte (such as those with U+2581, which B takes for a blank), have no tokens: zeros and an empty digest; they
count nowhere. Null ids stay null, very long texts are read whole, an empty table gives an empty result. Columns other than
the id and the text are not read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import saved, ship, text_of, worker_cache
from assay.llm.tokens import BYTE_SIGNS

#: Pieces that a worker keeps in each of two generations, and their longest; pairs that are broadcast.
KEPT, LONGEST, HOT = 100_000, 48, 1 << 20
#: Characters of texts that are aligned at once.
AT_ONCE = 4_000_000
#: White space but blanks and line feeds, and what some libraries take for it.
RARE_ASCII = [chr(c) for c in (*range(0x0A), *range(0x0B, 0x20), 0x7F)]
RARE = [chr(c) for c in (*range(0x80, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF)]
#: Where a text with other white space is cut.
CUT = re.compile(r"(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")
SPACE_SIGN = "\u2581"


def has_certain_cuts(text: str) -> bool:
    """Whether its white space is single blanks and line feeds between other signs."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in RARE_ASCII) and (text.isascii() or not any(c in text for c in RARE))


class Pair:
    """Two tokenizers, A byte-level, B with a space before the text; and what each id stands for in bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = {chr(sign): byte for byte, sign in BYTE_SIGNS.items()} | {chr(b): b for b in range(256) if b not in BYTE_SIGNS}
        n = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(n))]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_SIGN, " ").encode())
        #: Ids as text with what can follow them: a token of the same group and side, or else the other side, or a group.
        self.said = {k: np.array([f"{i}{k[1]}" for i in range(len(x))], object) for k, x in (("a,", self.bytes_a), ("a|", self.bytes_a), ("b,", self.bytes_b), ("b;", self.bytes_b))}
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        #: Whether B's pieces allow the cuts: none holds a line feed, none a blank after another sign.
        self.cuts = not any("\n" in p or SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def encode(self, sources: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of sources as they are, which begin with a blank or a line feed. B adds a blank of its own: it stands for the
        source's, or is a token before a line feed that isn't the source's. A blank and letters are one word of A, which its
        model takes without the library's cutting."""
        a: list[list[int] | None] = []
        tokenize, rest = self.a.model.tokenize, []
        for i, s in enumerate(sources):
            word = s[1:]
            if s[0] == " " and word.isalpha() and (word.isascii() or max(word) <= "\u024f"):
                a.append([x.id for x in tokenize("\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)))])
            else:
                a.append(None)
                rest.append(i)
        for i, x in zip(rest, self.a.encode_batch_fast([sources[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = x.ids
        b = self.b.encode([s[1:] if s[0] == " " else s for s in sources], num_threads=1)
        return a, [ids if s[0] == " " else ids[1:] for s, ids in zip(sources, b, strict=True)]

    def is_whole(self, source: str, a: list[int], b: list[int]) -> bool:
        own = source.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == own and b"".join(map(self.bytes_b.__getitem__, b)) == own

    def learn(self, sources: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups as text, codes of links) of each source; None if tokens don't give it back.

        All sources' tokens are one column a side. Sources follow each other, so the sum of lengths is also the source."""
        all_a, all_b = self.encode(sources)
        good = [True] * len(sources)
        if not self.is_whole("".join(sources), list(chain.from_iterable(all_a)), list(chain.from_iterable(all_b))):
            good = [self.is_whole(s, a, b) for s, a, b in zip(sources, all_a, all_b, strict=True)]
            all_a = [x if ok else [] for x, ok in zip(all_a, good, strict=True)]
            all_b = [x if ok else [] for x, ok in zip(all_b, good, strict=True)]
        many = [np.fromiter(map(len, xs), np.int64, len(xs)) for xs in (all_a, all_b)]
        ids_a, ids_b = (np.fromiter(chain.from_iterable(xs), np.int64, int(n.sum())) for xs, n in zip((all_a, all_b), many, strict=True))
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.union1d(ends_a, ends_b)  # each is the end of what one token of A and one of B share
        codes = (ids_a[np.searchsorted(ends_a, ends)] * len(self.bytes_b) + ids_b[np.searchsorted(ends_b, ends)]).astype("<i4").tobytes()
        number_a, number_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)  # of each token's group
        last_a, last_b = cuts[number_a] == ends_a, cuts[number_b] == ends_b
        order = np.argsort(np.concatenate([2 * number_a, 2 * number_b + 1]), kind="stable")
        said_a, said_b = np.where(last_a, self.said["a|"][ids_a], self.said["a,"][ids_a]), np.where(last_b, self.said["b;"][ids_b], self.said["b,"][ids_b])
        said = np.concatenate([said_a, said_b])[order].tolist()
        stops = [np.append(0, np.cumsum(n)) for n in many]
        source_ends = np.append(0, ends_a)[stops[0]]
        groups, links = np.searchsorted(cuts, source_ends, side="right"), np.searchsorted(ends, source_ends, side="right") * 4
        n_groups, tokens, links = np.diff(groups).tolist(), (stops[0] + stops[1]).tolist(), links.tolist()
        rows = zip(good, many[0].tolist(), many[1].tolist(), n_groups, tokens[:-1], tokens[1:], links[:-1], links[1:], strict=True)
        return [(a, b, g, "".join(said[i:j]), codes[x:y]) if ok else None for ok, a, b, g, i, j, x, y in rows]

    def known(self, sources: list[str]) -> list[tuple]:
        out = [self.kept.get(s) or self.older.get(s) for s in sources]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            found = self.learn([sources[i] for i in missing])
            if len(self.kept) + len(missing) > KEPT:
                self.older, self.kept = self.kept, {}
            for i, x in zip(missing, found, strict=True):
                out[i] = x
                if x is not None and len(sources[i]) <= LONGEST and len(self.kept) < KEPT:
                    self.kept[sources[i]] = x
        return out

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different pieces of texts, the place among them of each text's pieces in order, and where each text's begin."""
        sure = [self.cuts and has_certain_cuts(t) for t in texts]
        lists = pc.split_pattern(pc.replace_substring(pa.array([t if ok else "" for t, ok in zip(texts, sure, strict=True)], pa.large_string()), "\n", " \n"), " ")
        held = lists.flatten().dictionary_encode()
        sources = [p if p[:1] == "\n" else f" {p}" for p in held.dictionary.to_pylist()]
        which, starts = held.indices.to_numpy(), lists.offsets.to_numpy()
        if all(sure):
            return sources, which, starts
        place, parts = {s: i for i, s in enumerate(sources)}, []
        for i, (text, ok) in enumerate(zip(texts, sure, strict=True)):
            if ok:
                parts.append(which[starts[i] : starts[i + 1]])
            elif not text:
                parts.append(which[:0])
            else:
                own = CUT.split(f" {text}") if self.cuts else [f" {text}"]
                parts.append(np.array([place.setdefault(s, len(place)) for s in own]))
        return list(place), np.concatenate([which[:0], *parts]), np.cumsum([0, *map(len, parts)])

    def align(self, texts: list[str]) -> dict[str, object]:
        """Columns of the result of texts. codes and times are one array for all: distinct pairs and their numbers of links
        by text, of which ``ends`` tells where each text's end."""
        sources, which, starts = self.pieces(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        used = np.unique(which)
        info: list[tuple | None] = [(0, 0, 0, "", b"")] * len(sources)
        for i, x in zip(used.tolist(), self.known([sources[i] for i in used.tolist()]), strict=True):
            info[i] = x
        bad = np.array([x is None for x in info], bool)
        without = np.array([not t or SPACE_SIGN in t for t in texts], bool)
        without[owner[bad[which]]] = True
        kept = ~without[owner]
        which, owner = which[kept], owner[kept]
        numbers = np.array([x[:3] if x else (0, 0, 0) for x in info], np.int64).reshape(-1, 3)
        sizes = np.array([len(x[4]) // 4 if x else 0 for x in info], np.int64)
        flat, at = np.frombuffer(b"".join(x[4] for x in info if x), "<i4"), np.cumsum(sizes) - sizes
        stops = np.searchsorted(owner, np.arange(len(texts) + 1))
        sums = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(numbers[which], axis=0)])
        n_a, n_b, n_groups = np.diff(sums[stops], axis=0).T
        said = [x[3] if x else "" for x in info]
        places, cuts = which.tolist(), stops.tolist()
        digests = [hashlib.sha256("".join([said[k] for k in places[i:j]])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:], strict=False)]
        # A text's different pieces and how often it has them, then its different pairs and their links.
        each, times = np.unique(owner * max(1, len(sources)) + which, return_counts=True)
        owner, piece = np.divmod(each, max(1, len(sources)))
        width = sizes[piece]
        spread = np.repeat(at[piece] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        keys = (np.repeat(owner, width) << 31) | flat[spread]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.repeat(times, width)[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        links = np.add.reduceat(times, first) if len(first) else times
        ends = np.searchsorted(keys[first], np.arange(1, len(texts) + 1) << 31)
        total = np.diff(np.append(0, np.cumsum(links))[np.append(0, ends)])
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": total, "groups_sha256": digests, "codes": (keys[first] & ((1 << 31) - 1)).astype(np.int32), "times": links.astype(np.int32), "ends": ends}


def pair_of(path_a: str, path_b: str) -> Pair:
    return worker_cache("token_alignment", (path_a, path_b), lambda: Pair(path_a, path_b))


EACH = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>"


def parts_of(texts: list[str]) -> Iterator[slice]:
    """Runs of texts with about AT_ONCE characters together."""
    at = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > AT_ONCE:
            yield slice(at, i)
            at, n = i, 0
        n += len(t)
    yield slice(at, len(texts))


def align_each(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its numbers, digest and distinct linked pairs. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            row, own, texts = batch.columns
            texts = texts.to_pylist()
            for part in parts_of(texts):
                got = pair.align(texts[part])
                columns = [x.slice(part.start, part.stop - part.start) for x in (row, own)]
                columns += [*[pa.array(got[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(got["groups_sha256"], pa.string())]
                offsets = pa.array(np.append(0, got["ends"]), pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.array(got[k])) for k in ("codes", "times")]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EACH.split(", ")])

    ship(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), text_of(text).alias("text"))
    return own.mapInArrow(run, EACH)


def pair_counts(each: DataFrame, vocabulary_b: int) -> DataFrame:
    """(code, n, best): how many documents hold a pair, and whether no other pair of its A id is in more."""
    counts = each.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.expr(f"code div {vocabulary_b}"))  # at most as many rows as B has ids
    return saved(counts.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best")), "pair_counts")


def least_hot(counts: DataFrame, most: int) -> int:
    """The least power of two that at most so many pairs' counts reach."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()
    least, held = 1 << 62, 0
    for power, pairs in sizes:
        held += pairs
        if held > most:
            break
        least = 1 << power
    return least


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_a, n_b tokens, n_groups between common ends, n_links of tokens that share bytes, n_best links that no
    other pair of their A id exceeds in documents, count_sum of their pairs' documents, and the digest of the groups."""
    import sentencepiece

    vocabulary_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    each = saved(align_each(docs, path_a, path_b, id, text), "aligned")
    counts = pair_counts(each, vocabulary_b)
    least = least_hot(counts, HOT)
    held = each.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", "x.codes", "x.times").withColumnRenamed("codes", "code")
    hot, cold = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    met = held.join(F.broadcast(hot), "code")
    if least > 1:
        met = met.union(held.join(F.broadcast(hot), "code", "left_anti").join(cold, "code").select(met.columns))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = each.select("row", F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(id, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def token_arrays(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, a, b): ids and byte lengths of each whole text's tokens, encoded as one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))
        for batch in batches:
            texts, sides = batch.column(2).to_pylist(), ([], [])
            for t in texts:
                a, b = pair.encode([f" {t}"]) if t else ([[]], [[]])
                a, b = (a[0], b[0]) if t and pair.is_whole(f" {t}", a[0], b[0]) else ([], [])
                sides[0].append([{"id": i, "size": int(pair.length_a[i])} for i in a])
                sides[1].append([{"id": i, "size": int(pair.length_b[i])} for i in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(s, kind) for s in sides]], names=["row", "id", "a", "b"])

    ship(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), text_of(text).alias("text"))
    return own.mapInArrow(run, "row long, id long, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>")


def align_rows(tokens: DataFrame) -> DataFrame:
    """(row, number, a_place, b_place, a_id, b_id): all links of token_arrays' tokens, number that of their group, as a plan of
    rows alone: positions, cumulative lengths, an equi-join on row and end, running counts of cuts, a join within groups."""
    before = Window.partitionBy("row").orderBy("place")

    def side(name: str) -> DataFrame:
        each = tokens.select("row", F.posexplode(name).alias("place", "x")).select("row", "place", "x.id", "x.size")
        return each.withColumn("end", F.sum("size").over(before)).withColumn("start", F.col("end") - F.col("size"))

    a, b = side("a"), side("b")
    cuts = a.select("row", "end").join(b.select("row", "end"), ["row", "end"]).withColumn("cut", F.lit(1))

    def grouped(df: DataFrame, name: str) -> DataFrame:
        cut = F.coalesce("cut", F.lit(0))
        out = df.join(cuts, ["row", "end"], "left").withColumn("number", F.sum(cut).over(before) - cut)
        return out.select("row", "number", *[F.col(c).alias(f"{name}_{c}") for c in ("place", "id", "start", "end")])

    pairs = grouped(a, "a").join(grouped(b, "b"), ["row", "number"]).where("a_start < b_end AND b_start < a_end")
    return pairs.select("row", "number", "a_place", "b_place", "a_id", "b_id")
