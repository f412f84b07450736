"""A corpus pipeline: one stage per operator, each on all that the one before it kept. Part of the text subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from codeterra.llm.lineage import drop_stored, free, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the classifier learns from those of the labelled rows that are here."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = free("score", docs.columns)
    return toxicity.score(docs, model, made).where(F.col(made) < 0.5).drop(made)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, once; texts of one doc_id that are not near copies all stay."""
    return jaccard_join.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with an item of the benchmark go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    found = decontaminate.flagged(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0")
    return found.select(*[F.col("rest")[c].alias(c) if c in rest else c for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark, n_chars follows."""
    made = free("secrets", docs.columns)
    found = secret_scan.findings(docs, secret_scan.scan(docs), made)
    found = found.withColumn("text", secret_scan.redact(F.col("text"), F.col(made)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(made) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in which every source has its part of all tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("winnowing", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the first stage (a trained classifier) or the last (packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result stored as Parquet and read again, and deleted when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        drop_stored(before)
    made = STAGES[-1][1](spark, docs, sf_dir)
    drop_stored(docs)
    return made
