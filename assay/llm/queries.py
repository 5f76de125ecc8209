"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import arrow_shards, embedding_dups, lexical_search, licenses, mixing, packing, page_text, secret_scan, shingle_join, telephony, token_alignment, toxicity, url_rules
from assay.llm.tokens import tokenizer_path

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_table(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_documents(table(spark, sf_dir, "documents"))


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_arrow_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_shards.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_page_text, op2_telephony, op3_toxicity, op4_mixing, op5_url_rules, op6_packing, op7_licenses, op8_shingle_join, op9_embedding_dups, op10_arrow_shards, op11_secrets, op12_alignment, op13_search)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql(own: str) -> str:
    """own: a query with doc_id and text."""

    def canonical(text: str) -> str:
        form = f"regexp_replace({text}, {quoted(licenses.PROSE)}, 'copyright \\1', 'g')"
        form = f"lower(regexp_replace({form}, {quoted(licenses.NOTICE)}, '\\1', 'g'))"
        form = f"trim(regexp_replace(regexp_replace({form}, {quoted(licenses.ITEM)}, ' ', 'g'), {quoted(licenses.NOT_WORD)}, ' ', 'g'))"
        for one, other in licenses.SPELLINGS:
            form = f"replace({form}, {quoted(one)}, {quoted(other)})"
        return form

    texts = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known_texts())
    digests = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.DIGESTS.items()))
    return f"""
WITH each AS (SELECT name, sha256({canonical("body")}) AS digest FROM (VALUES {texts}) AS k(name, body) UNION ALL SELECT * FROM (VALUES {digests}) AS d(name, digest)),
known AS (SELECT min(name) AS license, digest FROM each GROUP BY digest),
own AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS form FROM ({own}))
SELECT doc_id, length(form) AS n_canonical, sha256(form) AS digest, license FROM own LEFT JOIN known ON sha256(form) = known.digest"""


ORACLES = {
    "op5_url_rules": f"""
WITH own AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) AS r(verdict, rule_host, rule_path)),
fits AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM own JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT own.page_id, own.host, own.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict FROM own LEFT JOIN fits ON own.page_id = fits.page_id""",
    "op7_licenses": licenses_sql("SELECT doc_id, text FROM documents"),
    "op11_secrets": secret_scan.secrets_sql(),
    "op13_search": lexical_search.search_sql(),
}
