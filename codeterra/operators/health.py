"""The explainable health score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(facts: DataFrame) -> DataFrame:
    """One row of facts(parsed, dead, in_cycles, average, high, medium, low) -> the four penalties, score, grade."""
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    parsed = F.greatest("parsed", F.lit(1))
    facts = facts.select(
        half_up(F.least(100 * F.col("dead") / parsed, F.lit(25.0))).alias("dead_penalty"),
        half_up(F.least(150 * F.col("in_cycles") / parsed, F.lit(25.0))).alias("cycle_penalty"),
        half_up(F.least(3 * F.greatest(F.col("average") - 4, F.lit(0.0)), F.lit(20.0))).alias("coupling_penalty"),
        F.least(8 * F.col("high") + 3 * F.col("medium") + F.col("low"), F.lit(30)).cast("long").alias("security_penalty"),
    )
    score = F.greatest(100 - F.col("dead_penalty") - F.col("cycle_penalty") - F.col("coupling_penalty") - F.col("security_penalty"), F.lit(0))
    facts = facts.withColumn("score", score.cast("long"))
    return facts.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F"))
