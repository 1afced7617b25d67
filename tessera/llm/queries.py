"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, curve_ann, gif, html_text, langid, license_scan, packing, simhash, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=512)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents")).drop("text_key")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(table(spark, sf_dir, "documents"))


def op8_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return curve_ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def payloads_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the media round trip what SQL can state: sizes and the digest of what was read back."""
    return op7_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the license scan what SQL can state: the places of the base phrases."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SQL = {
    "payloads_of_op7": """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(64, CAST(ceil(octet_length(raw) / 64) AS BIGINT) * 64) AS whole FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(whole AS BIGINT) AS payload_bytes, sha256(raw || repeat('\\x00'::BLOB, CAST(whole - n AS BIGINT))) AS payload_sha256 FROM p""",
    "base_of_op10": r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a, list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(g) AS BIGINT) AS n_base, CAST(list_min(m || a || g) AS BIGINT) AS first_word, CAST(list_max(m || a || g) AS BIGINT) AS last_word,
array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM h""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_toxicity, op4_byte_bpe, op5_simhash_near_dedup, op6_best_fit_packing, op7_gif_media, op8_curve_neighbours, op9_html_main_text, op10_license_scan, payloads_of_op7, base_of_op10)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
