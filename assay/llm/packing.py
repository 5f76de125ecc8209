"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily: the longest piece left, then again and again the longest that fits. Then its smallest piece is
replaced with two pieces left that fit the gap so expanded more tightly, the tightest two of all. As a bin depends on
lengths alone, bins are made from the histogram of lengths: at most ``capacity`` counts, however many documents there are,
and each kind of bin is used as often as the counts allow. So the corpus is packed as a whole, not by partition, and the
driver holds no more than the histogram and the kinds of bins. Pieces are then numbered within their length (common
lengths in many groups, so none is one task) and the number says which bin of which kind, and where in it.

Pieces of equal length go by id, piece and checksum; which of equal ones is first makes no difference. Only documents longer
than the capacity are cut, into pieces of the capacity; the last may be shorter. Null texts are
empty: one piece with the end id alone. Repeated rows and ids are each packed. An empty table gives no rows. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import id_text, saved, ship, text_of, with_id
from assay.llm.tokens import encoder

AT_ONCE = 1000
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, rule: str = "words", end_id: int = 0, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""
    ship(docs.sparkSession)
    own = docs.select(id_text(id_column).alias("doc_id"), text_of(text_column).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, rule), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in range(0, len(texts), AT_ONCE):
                out = []
                for doc_id, ids in zip(doc_ids[at : at + AT_ONCE], encode.encode(texts[at : at + AT_ONCE]), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        out.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_id(own.mapInPandas(cut, PIECE), "doc_id")


def bin_kinds(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins) that take all pieces. counts: pieces by length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    at = np.arange(capacity + 1)
    kinds = []
    while left.any():
        held, gap = [], capacity
        own = left.copy()
        longest = np.maximum.accumulate(np.where(own > 0, at, 0))
        while longest[gap]:
            length = int(longest[gap])
            n = min(int(own[length]), gap // length)
            own[length] -= n
            gap -= n * length
            held += [length] * n
            if not own[length]:
                longest = np.maximum.accumulate(np.where(own > 0, at, 0))
        if gap and len(held) > 1:
            small = held[-1]
            wide = gap + small
            first = at[1:wide][own[1:wide] > 0]  # the other: the longest left that still fits beside it
            if len(first):
                own_two = own.copy()
                second = longest[wide - first]
                alone = (second == first) & (own_two[first] < 2)
                if alone.any():
                    below = np.maximum.accumulate(np.where(own > 0, at, 0))
                    second = np.where(alone, below[np.maximum(second - 1, 0)], second)
                sums = np.where(second > 0, first + second, 0)
                best = int(sums.argmax())
                if sums[best] > small:
                    held = held[:-1] + sorted((int(first[best]), int(second[best])), reverse=True)
        lengths, uses = np.unique(held, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        kinds.append((sorted(held, reverse=True), times))
    return kinds


def slots_of(kinds: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, uses in a bin, offset), in ascending order of numbers."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for held, times in kinds:
        lengths, uses = np.unique(held, return_counts=True)
        offset = 0
        for length, use in zip(lengths.tolist()[::-1], uses.tolist()[::-1], strict=True):
            first = taken.get(length, 0)
            out.setdefault(length, []).append((first, sequence, use, offset))
            taken[length] = first + use * times
            offset += length * use
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 2048, rows_each: int = 1000) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be cheap to read again: a table."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(slots_of(bin_kinds(counts, capacity)))
    parts = spark.createDataFrame([(k, -(-n // rows_each)) for k, n in sorted(counts.items())] or [(0, 1)], "length long, parts long")
    own = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    sums = own.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("length", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    own = own.withColumn("number", number).join(sums, ["length", "part"])
    own = own.select(id_text("doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = slots.value
        for batch in batches:
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                slot = held[length]
                kind = slot[np.searchsorted(slot[:, 0], numbers[rows], side="right") - 1]
                since = numbers[rows] - kind[:, 0]
                sequence[rows] = kind[:, 1] + since // kind[:, 2]
                offset[rows] = kind[:, 3] + since % kind[:, 2] * length
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    return with_id(own.mapInPandas(put, f"{PIECE}, sequence_id long, offset long"), "doc_id")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    return pack_pieces(saved(pieces_of(docs, tokenizer, capacity=capacity, **options), "pieces"), capacity)
