"""The relations that the queries run on, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeterra.functions import texts
from codeterra.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("bytes"), texts.line_count(F.col("text")).alias("loc"), texts.content_hash(F.col("text")).alias("hash"))


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash"))
    return files(spark, sf_dir).where("doc_id % 10 <> 0").withColumn("hash", altered)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    return docs.select("doc_id", "path", "language", (F.col("k") + 1).cast("long").alias("line"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.where("src <> dst").distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part uses the one before it, in runs of 50; the middle of every second run uses another run, which makes cycles."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    last = part.agg(F.max("k").alias("last"))
    down = part.where("k % 50 <> 0 and k > 1").select(F.col("k").alias("src"), (F.col("k") - 1).alias("dst"))
    over = part.where("k % 100 = 25").join(F.broadcast(last)).select(F.col("k").alias("src"), ((F.col("k") * 7 + 2) % F.col("last") + 1).alias("dst"))  # one row
    back = part.where("k % 70 = 30").select(F.col("k").alias("src"), (F.col("k") + 6).alias("dst")).join(part.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst")
    return down.union(over).union(back).where("src <> dst").distinct()


def spread(df: DataFrame, key: str, rows: int = 4096) -> DataFrame:
    """df in tasks of about so many rows, for rows that become much larger than the file, whose size alone decides else."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def settled(df: DataFrame) -> DataFrame:
    """df computed once, for plans that use it twice."""
    return checkpointed(df)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_suppkey")
    return items.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("sha"), F.col("l_shipdate").alias("ts"), F.row_number().over(order).alias("ordinal"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
