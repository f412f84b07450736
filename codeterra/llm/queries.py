"""Queries of this subpackage for the driver: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.llm import alignment, curriculum, decontaminate, jaccard_join, license_scan, merkle, oracles, packing, quality_rules, secret_scan, substring_dedup, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_likeness(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.findings(docs, secret_scan.scan(docs))
    counts = [secret_scan.count_of(F.col("spans"), rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.RULES]
    spans = secret_scan.listed(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # exact in the operator at any size; here null where a long can't hold it
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    # weights 3, 1, 2 in turn; the first as steady as it is, the second ever more, the third ever less of it
    plan = curriculum.cycled((3.0, 1.0, 2.0), (curriculum.STEADY, ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5))))
    found = curriculum.by_position(curriculum.assign(_table(spark, sf_dir, "documents"), plan))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), packing.tokenizer_path(alignment.FIRST), packing.tokenizer_path(alignment.SECOND))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_merkle": op2_merkle,
    "op3_secret_scan": op3_secret_scan,
    "op4_winnowing": op4_winnowing,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_curriculum": op12_curriculum,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": oracles.SECRETS,
    "op4_winnowing": oracles.WINNOWING,
    "op5_url_filter": oracles.URL_FILTER,
    "op7_jaccard_join": oracles.JACCARD_JOIN,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op12_curriculum": oracles.CURRICULUM,
}
