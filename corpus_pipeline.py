"""A corpus pipeline: each stage works on all that the one before it kept.

Every stage takes and, but for the last, returns the columns of documents; columns beside doc_id, text and source are carried
along unread, whatever their names. Empty tables stay empty. What each stage makes of nulls, empty and very long texts, ties
and repeated rows:

- toxicity: null and empty texts have no toxic word and stay; rows with a null id are scored by their texts like any others;
  repeated rows stay or go together. Very long texts are read whole.
- jaccard: null, empty and wordless texts link with nothing and stay, once for each id; of repeated rows and of linked ones
  that with the smallest id stays; rows with a null id link with nothing and all stay.
- mixing: null and empty texts have size 0 and are rounded on their own; documents whose copies round to 0 go, and one that is
  taken several times is as many rows. Null sources are a source, the last. Draws follow the id and the number of the repeat.
- packing: repeated rows are documents of their own; pieces of equal length are placed by id, piece and content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import mixing, packing, shingle_join, toxicity
from assay.llm.tokens import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return shingle_join.keep_one_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("jaccard", jaccard_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
