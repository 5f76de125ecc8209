"""Token ids as Arrow IPC files of fixed-size-list batches, and back.

Documents are dealt to shards by ranges of doc_id and a hash of the text, as many as the texts' bytes make at ``shard_bytes``
each, and sorted; each shard is one stream of ids cut into sequences of equal
length: a file with the columns ids (fixed_size_list<uint16 or uint32>[length]) and mask (fixed_size_list<bool>[length], a
bit for each id, false where the last sequence is filled up; lengths are multiples of 8), in batches of ``rows`` sequences. Sequence i is row i % rows of batch i // rows, so
a memory-mapped reader reaches it without copying or reading the rest. A second file of the shard, with the ending
.index.arrow, has (doc_id, start, n_tokens) of its documents. A task that is run again writes files of its own name; only
those of the run that counted are read.

Null texts are empty: only the end id. Very long texts run over as many sequences as they need. Null ids come first. Rows with equal ids are ordered by a
hash of the text and by the text; each is a document, and they can be in several shards, so no id makes a shard large.
An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import id_text, new_path, saved, ship, text_of, with_id
from assay.llm.tokens import encoder

AT_ONCE = 1000
INDEX_ROWS = 65536


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class ShardWriter:
    def __init__(self, uri: str, length: int, rows: int, dtype: str):
        self.store, path = place(uri)
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        self.path, self.length, self.rows = path, length, rows
        if length % 8:
            raise ValueError("the length must be a multiple of 8")
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.dtype, self.schema = dtype, pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.store.open_output_stream(path)
        self.file = ipc.new_file(self.sink, self.schema)
        self.waiting, self.held, self.total = [], 0, 0
        self.index: list[tuple] = []
        self.index_schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens")])
        self.index_sink = self.store.open_output_stream(f"{path}.index.arrow")
        self.index_file = ipc.new_file(self.index_sink, self.index_schema)

    def add(self, doc_id, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"an id is too large for {self.dtype}")
        self.index.append((doc_id, self.total, len(ids)))
        if len(self.index) == INDEX_ROWS:
            self.flush_index()
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 16 * self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        each = self.length * self.rows
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        while len(flat) >= each or last and len(flat):
            part, flat = flat[:each], flat[each:]
            mask = np.ones(len(part), bool)
            if spare := -len(part) % self.length:
                part, mask = np.concatenate([part, np.zeros(spare, self.dtype)]), np.concatenate([mask, np.zeros(spare, bool)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.waiting, self.held = [flat] if len(flat) else [], len(flat)

    def flush_index(self) -> None:
        columns = [pa.array([x[i] for x in self.index], pa.int64()) for i in range(3)]
        self.index_file.write_batch(pa.record_batch(columns, schema=self.index_schema))
        self.index = []

    def close(self) -> int:
        self.flush(True)
        if self.index:
            self.flush_index()
        for x in (self.file, self.sink, self.index_file, self.index_sink):
            x.close()
        return self.total


class Shard:
    """A written shard; local files are mapped, not read."""

    def __init__(self, uri: str):
        store, path = place(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.index = ipc.open_file(pa.memory_map(f"{path}.index.arrow") if local else store.open_input_file(f"{path}.index.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of the ids and of the mask's bits (eight in a byte, the first the lowest) of sequence i."""
        batch, at = self.file.get_batch(i // self.rows), i % self.rows * self.length
        bits = np.frombuffer(batch.column(1).values.buffers()[1], np.uint8)
        return batch.column(0).values.to_numpy(zero_copy_only=True)[at : at + self.length], bits[at // 8 : (at + self.length) // 8]

    def mask(self, i: int) -> np.ndarray:
        return np.unpackbits(self.sequence(i)[1], bitorder="little").astype(bool)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, one batch in memory at a time."""
        each, held, first = self.rows * self.length, np.zeros(0, np.uint16), 0
        following = 0
        for k in range(self.index.num_record_batches):
            columns = self.index.get_batch(k)
            for doc_id, start, n in zip(*(columns.column(i).to_pylist() for i in range(3)), strict=True):
                parts = [held[start - first : start - first + n]]
                while start + n > following * each and following < self.file.num_record_batches:
                    batch = self.file.get_batch(following)
                    held, first = batch.column(0).values.to_numpy(zero_copy_only=True), following * each
                    parts.append(held[max(0, start - first) : start + n - first])
                    following += 1
                yield doc_id, start, np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, rule: str = "bytes", length: int = 2048, rows: int = 64, dtype: str = "uint16", shard_bytes: int = 1 << 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the shards below folder. Returns (shard, path, n_docs, n_tokens), already computed; shard follows doc_id."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    shards = max(1, -(-(own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // shard_bytes))
    own = own.withColumn("place", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "place")
    own = own.sortWithinPartitions("doc_id", "place", "text").select(id_text("doc_id").alias("doc_id"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, writer, n, path = encoder(tokenizer, rule), None, 0, f"{folder}/{uuid.uuid4().hex}.arrow"
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in range(0, len(texts), AT_ONCE):
                writer = writer or ShardWriter(path, length, rows, dtype)
                for doc_id, found in zip(ids[at : at + AT_ONCE], encode.encode(texts[at : at + AT_ONCE]), strict=True):
                    writer.add(None if doc_id is None else int(doc_id), np.frombuffer(found + end, dtype="<u4"))
                    n += 1
        if writer:
            total = writer.close()
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n], "n_tokens": [total]})

    return saved(own.mapInPandas(write, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all before it."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    own = shards.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                out: list[tuple] = []
                for doc_id, start, ids in Shard(path).documents():
                    out.append((None if doc_id is None else str(doc_id), base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_id(own.repartition(tasks, "path").mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long"), "doc_id")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    folder = new_path(docs.sparkSession, "arrow-shards")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, **options))
