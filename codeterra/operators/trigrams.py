"""A stored trigram index: the rows, a posting list for each trigram, and the lists' lengths.

A search reads the posting lists of its question's trigrams only, and of the longest of these only what the others leave open;
its results are those of the scan in `search`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.functions import texts

#: Rows of a file of the index, whose trigrams one task takes.
ROWS = 1 << 16
#: Winners that are looked up by their ids; more (ties) are joined.
LOOKED_UP = 1000
#: Values of one IN that Parquet tests one by one (spark.sql.parquet.pushdown.inFilterThreshold).
_IN = 10
#: Scores are rounded to six digits, so a bound on the true score gives way by this much.
_SLACK = 1e-6


def build(rows: DataFrame, by: str, root: str, owner: str | None = None) -> TrigramIndex:
    """Indexes rows by their column `by` in the folder root, which must be new. Searches can be kept to one value of `owner`.

    Rows whose text is null or has no letter or digit are kept but never found; equal rows are found as often as they are there.
    Lists are written in the order of trigram, owner, size and id, cut into files by ranges of that order, so that one trigram of
    most rows is spread over many files and one owner's rows lie together.
    """
    spark = rows.sparkSession
    rows.repartition(max(1, -(-rows.count() // ROWS))).select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).write.parquet(f"{root}/rows")
    kept = spark.read.parquet(f"{root}/rows")
    owned = F.col("row")[owner].cast("string") if owner else F.lit(None).cast("string")
    split = kept.select("id", owned.alias("owner"), texts.trigrams(F.col("row")[by].cast("string")).alias("grams"))
    order = ["gram", "owner", "n", "id"]
    lists = split.select("id", "owner", F.size("grams").alias("n"), F.explode("grams").alias("gram")).repartitionByRange(*order).sortWithinPartitions(*order)
    lists.select(*order).write.parquet(f"{root}/lists")
    found = TrigramIndex(spark, root)
    found.lists.groupBy("gram").agg(F.count("*").alias("length")).write.parquet(f"{root}/lengths")
    return found


def _any(column: str, values: list) -> Column:
    """column IN values, in pieces that reach the Parquet reader as values and not as a range."""
    return reduce(Column.__or__, [F.col(column).isin(values[k : k + _IN]) for k in range(0, len(values), _IN)], F.lit(False))


class TrigramIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.rows = spark.read.parquet(f"{root}/rows")
        self.lists = spark.read.schema("gram string, owner string, n int, id bigint").parquet(f"{root}/lists")

    def _asked(self, question: str) -> list[str]:
        """The question's trigrams, those of the shortest lists first."""
        one = self.spark.range(1).select(F.explode(texts.trigrams(F.lit(question))).alias("gram"))
        grams = [r["gram"] for r in one.collect()]  # as long as the question
        lengths = self.spark.read.schema("gram string, length bigint").parquet(f"{self.root}/lengths").where(_any("gram", grams))
        known = {r["gram"]: r["length"] for r in lengths.collect()}  # a row for each of the question's trigrams
        return sorted(grams, key=lambda g: (known.get(g, 0), g))

    def search(self, question: str, n: int, least: float, order: list[str], owner: object = None) -> DataFrame:
        """(row, score), row being a struct of the index' columns: the n rows most similar to the question, above least, by falling score and then `order`.

        A row that reaches score t shares t times the question's trigrams at least, so it is in one of the shortest lists, and
        its own trigrams are at least that many. A first look at the shorter half of the lists says which score n rows reach
        anyway; that is t for the second, which counts the rest of the lists only for rows that can still reach it.
        """
        grams = self._asked(question)
        of = len(grams)
        none = self.rows.select("row", F.lit(None).cast("double").alias("score")).limit(0)
        if not grams or n < 1:
            return none
        lists = self.lists if owner is None else self.lists.where(F.col("owner") == str(owner))
        shared = lambda some, t: lists.where(_any("gram", some) & F.col("n").between(math.ceil(t * of), math.floor(of / t))).groupBy("id", "n").agg(F.count("*").alias("shared"))
        score = lambda c: F.round(c / (F.col("n") + of - c), 6)
        first = shared(grams[: (of + 1) // 2], least).select(score(F.col("shared")).alias("score")).where(F.col("score") > least)
        reached = [r["score"] for r in first.orderBy(F.desc("score")).limit(n).collect()]  # n numbers
        t = max(least, reached[-1] if len(reached) == n else 0) - _SLACK
        short = of - max(1, math.ceil(t * of)) + 1
        most = F.least(F.col("shared") + of - short, F.col("n"), F.lit(of))
        can = shared(grams[:short], t).where(score(most) >= t)
        if short < of:
            late = shared(grams[short:], t).select("id", F.col("shared").alias("more"))
            can = can.join(late, "id", "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0)))
        winners = can.select("id", score(F.col("shared")).alias("score")).where((F.col("score") > least) & (F.col("score") >= t))
        best = winners.orderBy(F.desc("score"), "id").limit(LOOKED_UP + 1).collect()  # bounded
        if len(best) > LOOKED_UP:  # ties or a great n
            rows = self.rows.join(winners, "id")
        elif best:
            scores = self.spark.createDataFrame([tuple(r) for r in best], "id bigint, score double")
            rows = self.rows.where(_any("id", [r["id"] for r in best])).join(F.broadcast(scores), "id")  # LOOKED_UP rows at most
        else:
            return none
        return rows.select("row", "score").orderBy(F.desc("score"), *[F.col("row")[c] for c in order]).limit(n)
