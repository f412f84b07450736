"""What readers ask of one analysis' tables: lists in a fixed order, bounded by what the caller wants and a largest number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.operators import graph, search, trigrams
from codeterra.operators.grounding import CLAIMS, points_of


def clamp(n: int, low: int, high: int) -> int:
    return min(max(n, low), high)


def api_shape(rows: DataFrame) -> DataFrame:
    """Columns named as an API's fields are, times as ISO texts in UTC."""
    name = lambda c: "".join(x if k == 0 else x.capitalize() for k, x in enumerate(c.split("_")))
    shown = lambda f: F.date_format(F.col(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if f.dataType.typeName().startswith("timestamp") else F.col(f.name)
    return rows.select(*[shown(f).alias(name(f.name)) for f in rows.schema.fields])


def file_list(files: DataFrame, by: str = "path", most: int = 500) -> DataFrame:
    order = [F.desc("dependents"), F.col("path")] if by == "dependents" else [F.col("path")]
    return files.select("path", "language", "loc", "bytes", "parsed", "skip_reason", "dependents").orderBy(*order).limit(min(most, 5000))


def edge_list(edges: DataFrame, most: int = 5000) -> DataFrame:
    return edges.select("src", "dst", "kind", "line", "confidence").orderBy("src", "dst", "kind").limit(min(most, 20_000))


def graph_nodes(files: DataFrame, edges: DataFrame, most: int = 3000) -> DataFrame:
    """(path, language, loc, dependents, dependencies, blast, total, truncated): the files that most depend on, larger ones first among equals."""
    most = clamp(most, 1, 20_000)
    total = files.agg(F.count("*").alias("total"))
    top = files.orderBy(F.desc("dependents"), F.desc("loc"), "path").limit(most)
    out = top.join(graph.dependencies(edges).withColumnRenamed("node", "path"), "path", "left").join(F.broadcast(total))  # one row
    return out.select("path", "language", "loc", "dependents", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), "blast", "total", (F.col("total") > most).alias("truncated"))


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the shown nodes."""
    return graph.within(edges, nodes.select(F.col("path").alias("node"))).select("src", "dst", "confidence")


def node_size(loc: Column) -> Column:
    return F.least(3 + F.sqrt(loc) / 4, F.lit(14.0))


def largest(files: DataFrame) -> DataFrame:
    """One row: the highest numbers of dependents and blast, 1 at least, to scale by."""
    return files.agg(F.greatest(F.max("dependents"), F.lit(1)).alias("dependents"), F.greatest(F.max("blast"), F.lit(1)).alias("blast"))


def symbols_of(symbols: DataFrame, path: str, most: int = 500) -> DataFrame:
    return symbols.where(F.col("path") == path).select("name", "kind", "line").orderBy("line", "name").limit(most)


def neighbours(edges: DataFrame, path, most: int = 200) -> DataFrame:
    """(side, node): who uses the file (in) and whom it uses (out), each once, the first `most` of a side by name."""
    side = lambda at, other, name: edges.where(F.col(at) == path).select(F.lit(name).alias("side"), F.col(other).alias("node")).distinct().orderBy("node").limit(most)
    return side("src", "dst", "out").union(side("dst", "src", "in"))


def ranked(files: DataFrame, by: str, most: int = 20) -> DataFrame:
    """Files with the highest churn, blast or dependents, those with none left out."""
    return files.where(F.col(by) > 0).orderBy(F.desc(by), "path").limit(clamp(most, 1, 200))


def insight(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("churn", "blast", "authors").limit(1)


def entry_points(files: DataFrame, is_entry: Column, most: int = 12) -> DataFrame:
    """(path, line): the first files that look like entry points."""
    return files.where(is_entry).select("path", F.lit(1).alias("line")).orderBy("path").limit(most)


def summary_files(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("dependents"), "path")


def counts(files: DataFrame, symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: files, symbols, file summaries."""
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    return one(files, "files").join(F.broadcast(one(symbols, "symbols"))).join(F.broadcast(one(summaries.where("scope = 'file'"), "file_summaries")))  # one row each


def latest_summary(summaries: DataFrame, runs: DataFrame, analysis_id, user_id, scope: str, key: str | None = None) -> DataFrame:
    """A user's summaries of one scope from the latest run that has any: all keys in order, or one key's row."""
    own = summaries.where((F.col("analysis_id") == analysis_id) & (F.col("user_id") == user_id) & (F.col("scope") == scope))
    if key is not None:
        own = own.where(F.col("key") == key)
    run = own.select("comprehension_id").distinct().join(runs.select(F.col("id").alias("comprehension_id"), "created_at"), "comprehension_id")
    last = run.orderBy(F.desc("created_at"), F.desc("comprehension_id")).limit(1).select("comprehension_id")
    return own.join(F.broadcast(last), "comprehension_id", "left_semi").orderBy("key")  # one row


def digest(rows: DataFrame) -> DataFrame:
    """The repository's summary with its detail's sections: a missing purpose is the points, other missing sections are empty."""
    none = F.array().cast(CLAIMS)
    rest = [F.coalesce(f"detail.{x}", none).alias(x) for x in ("stack", "entrypoints", "how_to_run", "notes")]
    return rows.select("headline", F.coalesce("detail.purpose", "points", none).alias("purpose"), *rest, "model")


def _named(symbols: DataFrame) -> DataFrame:
    return symbols.select("path", "line", F.concat_ws(" ", "kind", "name").alias("text"), "name")


def _paths(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit(1).alias("line"), F.col("path").alias("text"))


def _points(summaries: DataFrame, *more: str) -> DataFrame:
    return points_of(summaries.where(F.col("scope").isin("file", "module")).select(F.col("key").alias("path"), "points", *more))


def _best(parts: list[DataFrame], most: int) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.desc("score"), "kind", "path", "line").limit(most)


def evidence(files: DataFrame, symbols: DataFrame, summaries: DataFrame | None, user_id, question: str, most: int = 20) -> DataFrame:
    """(kind, path, line, text, score) of the best matches among symbols, paths and this user's summary points.

    Nothing is found for a blank question, nor summaries without a user; other users' summaries are never read.
    """
    question = question.strip()
    parts = [search.scored(_named(symbols), "name", question, 20, "symbol"), search.scored(_paths(files), "text", question, 15, "file")]
    if summaries is not None and user_id is not None:
        own = _points(summaries.where(F.col("user_id") == user_id))
        parts.append(search.scored(own, "text", question, 15, "point").where("line is not null"))
    return _best(parts, most)


def index_evidence(files: DataFrame, symbols: DataFrame, summaries: DataFrame | None, root: str) -> None:
    """Stores below root, a new folder, what indexed_evidence() searches; summary points by their user."""
    trigrams.build(_named(symbols), "name", f"{root}/symbols")
    trigrams.build(_paths(files), "text", f"{root}/files")
    if summaries is not None:
        trigrams.build(_points(summaries, "user_id"), "text", f"{root}/points", owner="user_id")


def indexed_evidence(spark: SparkSession, root: str, user_id, question: str, most: int = 20, points: bool = True) -> DataFrame:
    """What evidence() finds, from the index below root; points is false where it was built without summaries."""
    question, at = question.strip(), lambda name: trigrams.TrigramIndex(spark, f"{root}/{name}")
    parts = [search.indexed(at("symbols"), question, 20, "symbol"), search.indexed(at("files"), question, 15, "file")]
    if points and user_id is not None:
        parts.append(search.indexed(at("points"), question, 15, "point", user_id).where("line is not null"))
    return _best(parts, most)
