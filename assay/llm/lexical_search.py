"""Ranked lexical search of a corpus for a set of items: a postings table in term buckets, scores in whole numbers.

1. Every document's terms are counted. The empty string counts as one more term of each document that has any, so its
   postings list is the list of documents, and one pass over the texts gives postings, the number of documents N and the
   number of all terms L. Terms that no item has are left out before anything is shuffled.
2. Postings (term, document, n, tf) are written in buckets of terms, sorted by term. Each bucket is cut into slices of
   documents, so that a term which most documents have is many lists of bounded length rather than one long one.
3. Document frequencies are counted from the postings; the weights of the items' terms meet the postings by term, and each
   posting is scored once, whatever the number of items that have its term.
4. Scored postings are dealt by document, meet the items that have their term, and are summed for each item and document,
   which needs no further shuffle; the ten best of each item are the first rows of a window, of which every partition passes
   on its own best alone.

Item terms are broadcast while they are at most BROADCAST_ROWS (counted); beyond that Spark joins them as it sees fit, with
the same result.

Rows of items with the same id are one item with the terms of all; a null id is an id. Each row of docs is a document of its
own, repeated ones too, and ties in score go by doc_id, nulls first, copies in any order among themselves (they look alike).
Null and empty texts and texts without terms aren't documents: they count nowhere. Items without a hit have no row; an empty
table gives an empty result. Very long texts are counted whole. Columns other than ids and texts are not read, so others may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import saved, text_of

#: A term is a run of anything but ASCII characters that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of (item, term) that are broadcast; documents that a slice of a bucket holds; buckets of terms.
BROADCAST_ROWS, SLICE, BUCKETS = 500_000, 16_384, 256


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def small(term: Column) -> Column:
    """A-Z in lower case and nothing else; most terms have none, which lower() tells faster."""
    return F.when(F.lower(term) == term, term).otherwise(F.translate(term, CAPITALS, SMALL))


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each pair once; written, as it is needed several times and its size decides a strategy."""
    each = items.select(F.col(id).alias("item"), F.explode(terms_of(text_of(text))).alias("term"))
    return saved(each.select("item", small(F.col("term")).alias("term")).distinct(), "item_terms")


def build_postings(docs: DataFrame, wanted: DataFrame, few: bool, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, row, doc, n, tf) of the terms in wanted, and of the empty term that every document has."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc"), terms_of(text_of(text)).alias("terms")).where(F.size("terms") > 0)
    each = own.select("row", "doc", F.size("terms").cast("long").alias("n"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    kept = each.withColumn("term", small(F.col("term"))).join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    counted = kept.groupBy("term", "row", "doc", "n").agg(F.count("*").alias("tf"))
    slices = max(1, -(-docs.count() // SLICE))
    dealt = counted.repartition(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)), F.pmod(F.xxhash64("row"), F.lit(slices)))
    return saved(dealt.sortWithinPartitions("term", "row"), "postings")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double")))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    asked = item_terms(items, item_id, item_text)
    few = asked.count() <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if few else df
    wanted = asked.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    postings = build_postings(docs, wanted, few, id, text)
    n_docs, n_terms = postings.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    real = postings.where("term <> ''")
    weights = real.groupBy("term").agg(F.count("*").alias("df")).select("term", weight(n_docs, F.col("df")).alias("w"))
    m = F.expr(f"{100 - 90}L + ((90L * n * {n_docs}L) div {max(1, n_terms)}L)")
    hits = real.join(held(saved(weights, "weights")), "term").withColumn("m", m)
    hits = hits.select("term", "row", "doc", (F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).alias("points")).where("points > 0")
    scored = hits.repartition("row").join(held(asked), "term").groupBy("row", "doc", "item").agg(F.sum("points").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"), F.asc("row"))
    out = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id), "score")


def search_sql(docs: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """The same ranking by DuckDB."""
    terms = f"regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{TERM}')"
    return f"""
WITH own AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS terms FROM {docs}),
sizes AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM own WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM {items}),
postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM own) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term, n_docs),
scored AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM postings JOIN sizes USING (row) JOIN weights USING (term) JOIN asked USING (term), total GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {k}"""
