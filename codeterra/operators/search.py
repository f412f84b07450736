"""Trigram search and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.functions import texts
from codeterra.operators.trigrams import TrigramIndex

LEAST = 0.1


def trigram_search(rows: DataFrame, text: str, question: str, n: int, kind: str) -> DataFrame:
    """(kind, key, text, score): the n rows most similar to the question, above LEAST; none for a blank question."""
    asked = texts.trigrams(F.lit(question))
    score = F.round(texts.similarity(texts.trigrams(F.col(text)), asked), 6)
    found = rows.where(F.lit(bool(question.strip()))).select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.col(text).alias("text"), score.alias("score"))
    return found.where(F.col("score") > LEAST).orderBy(F.desc("score"), "key").limit(n)


def scored(rows: DataFrame, by: str, question: str, n: int, kind: str) -> DataFrame:
    """rows(path, line, text, ...) -> (kind, path, line, text, score): the n rows whose column `by` is most similar to the question, above LEAST."""
    score = F.round(texts.similarity(texts.trigrams(F.col(by)), texts.trigrams(F.lit(question))), 6)
    found = rows.where(F.lit(bool(question.strip()))).select(F.lit(kind).alias("kind"), "path", F.col("line").cast("long").alias("line"), "text", score.alias("score"))
    return found.where(F.col("score") > LEAST).orderBy(F.desc("score"), "path", "line", "text").limit(n)


def indexed(index: TrigramIndex, question: str, n: int, kind: str, owner: object = None) -> DataFrame:
    """What scored() finds in the rows that the index was built of, read from the lists of the question's trigrams."""
    found = index.search(question if question.strip() else "", n, LEAST, ["path", "line", "text"], owner)
    return found.select(F.lit(kind).alias("kind"), "row.path", F.col("row.line").cast("long").alias("line"), "row.text", "score")


def evidence(parts: list[DataFrame], n: int = 20) -> DataFrame:
    """The best n of several searches."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.desc("score"), "kind", "key").limit(n)
