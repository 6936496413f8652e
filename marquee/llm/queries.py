"""Queries of this subpackage: ``key -> (spark, sf_dir) -> DataFrame``, each
over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    collocations,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    minhash_dedup,
    mixing,
    packing,
    substring_dedup,
    token_files,
    url_filter,
    vector_codes,
    vector_search,
)
from marquee.llm.common import load

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(load(spark, sf_dir, "documents"), path, content={"ids_crc32": F.crc32("ids")})


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(load(spark, sf_dir, "documents"))


ORACLE_SQL["op6_source_mixing"] = mixing.ORACLE


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(load(spark, sf_dir, "documents"))


@query
def op8_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


ORACLE_SQL["op8_url_language_model"] = url_filter.ORACLE


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


ORACLE_SQL["op9_minhash_near_dedup"] = minhash_dedup.ORACLE


@query
def op10_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


ORACLE_SQL["op10_grace_exact_dedup"] = exact_dedup.ORACLE


@query
def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(load(spark, sf_dir, "documents"), path, end_id=1)
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op4_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_sentences(load(spark, sf_dir, "documents"))
    return found.withColumn("n_removed", F.size("removed"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", F.size("blocks").alias("n_blocks"), F.to_json("blocks").alias("blocks"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


ORACLE_SQL["op11_collocations"] = collocations.ORACLE


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(load(spark, sf_dir, "embeddings"))


ORACLE_SQL["op12_vector_codes"] = vector_codes.ORACLE


@query
def op13_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(load(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_voronoi_top_k"] = vector_search.ORACLE
