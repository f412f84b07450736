"""History operators on commits(path, author, sha, ts, ordinal), ordinal 1 being the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.count("*").alias("commits"), F.min_by("ts", "ordinal").alias("last_commit_at"))


def top_authors(commits: DataFrame, n: int = 3) -> DataFrame:
    """(path, rank, author, commits): the n authors with the most commits, ties by author."""
    counts = commits.groupBy("path", "author").agg(F.count("*").alias("commits"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("commits"), "author"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("path", F.col("rank").cast("int"), "author", "commits")


def hotspots(files: DataFrame, n: int = 20) -> DataFrame:
    """files(path, loc, churn, dependents) -> the n paths of highest risk among those changed more than once."""
    risk = F.round(F.col("churn") * F.log10(F.col("loc") + 10) * (1 + F.col("dependents") / 5), 2)
    return files.withColumn("risk", risk).where("churn > 1 and risk > 0").orderBy(F.desc("risk"), "path").limit(n)
