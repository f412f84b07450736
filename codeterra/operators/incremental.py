"""Incremental re-analysis: what a previous snapshot still tells about the current files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reused(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose path and hash the snapshot has; their parse results are kept."""
    return files.join(previous.select("path", "hash"), ["path", "hash"], "left_semi")


def changed(files: DataFrame, previous: DataFrame) -> DataFrame:
    return files.join(previous.select("path", "hash"), ["path", "hash"], "left_anti")


def merged_edges(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """Fresh edges and kept ones; of equal (src, dst, kind) a fresh one wins, then the lowest line."""
    both = fresh.withColumn("old", F.lit(0)).unionByName(kept.withColumn("old", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("old", "line"))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank")


def live_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose two ends are still files. Files are looked up by hash, so that edges, which may be far more, are not sorted."""
    known = files.select("path").distinct().hint("shuffle_hash")
    kept = edges.join(known.withColumnRenamed("path", "src"), "src", "left_semi")
    return kept.join(known.withColumnRenamed("path", "dst"), "dst", "left_semi").select(*edges.columns)


def merged_counts(fresh: DataFrame, kept: DataFrame, *key: str) -> DataFrame:
    return fresh.unionByName(kept).groupBy(*key).agg(F.sum("count").alias("count"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")
