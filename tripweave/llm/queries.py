"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import exact_dedup, language, mixing, oracles, packing, quality_model, quality_rules, secret_scan, simhash, token_counts, token_files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(n: int) -> Column:
    """Remainder of the CRC-32 of the document's id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    manifest = token_files.write_token_files(docs, "byte_bpe_50k.json")
    return token_files.read_token_files(manifest, docs, with_ids=False).drop("ids")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs, fold(4) != 2)
    return language.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(3) != 1)
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), "piece_bpe_32k.model")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), "word_bpe_49k.json", with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_files, op3_language, op4_secret_scan, op5_quality_rules, op6_exact_dedup, op7_quality_model, op8_token_counts, op9_mix, op10_pack)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": oracles.quality_rules("documents"),
        "op6_exact_dedup": oracles.exact_duplicates("documents"),
        "op9_mix": oracles.mix("documents"),
    }
