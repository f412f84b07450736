"""A whole analysis: from a repository's files and history to all tables, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.functions import paths, texts
from codeterra.operators import graph, health, history, incremental, inventory, parsing, resolve, security, syntax
from codeterra.session import checkpointed
from codeterra.sources import git

#: Stages with the percentage that a job shows when one begins.
STAGES = {"resolve": 5, "fetch": 20, "inventory": 35, "parse": 70, "link": 82, "metrics": 94, "publish": 100}
LABELS = {
    "resolve": "Reading the address",
    "fetch": "Fetching the repository",
    "inventory": "Listing files",
    "parse": "Reading structure",
    "link": "Linking imports",
    "metrics": "Measuring",
    "publish": "Storing results",
}
HIGH_FANOUT = 12


@dataclass
class Previous:
    """What the last analysis of the same repository holds."""

    files: DataFrame  # path, hash, engine
    symbols: DataFrame  # path, line, name, kind
    edges: DataFrame  # src, dst, kind, line, confidence
    findings: DataFrame
    file_externals: DataFrame  # path, specifier, count


@dataclass
class Analysis:
    files: DataFrame  # the inventory with engine, dependents, churn, authors, last_commit_at, blast
    totals: DataFrame
    edges: DataFrame
    external: DataFrame
    file_externals: DataFrame
    unresolved: DataFrame
    symbols: DataFrame
    findings: DataFrame
    cycles: DataFrame
    dead: DataFrame
    hotspots: DataFrame
    fan_out: DataFrame
    health: DataFrame
    engines: DataFrame
    reused: DataFrame
    warnings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Those that a store keeps by analysis."""
        return {name: getattr(self, name) for name in ("files", "edges", "symbols", "findings", "file_externals")}


def is_entry(path: Column) -> Column:
    return paths.is_entry_point(path)


def insights(files: DataFrame, edges: DataFrame, commits: DataFrame, blast: DataFrame) -> DataFrame:
    """files with dependents, churn, authors, last_commit_at and blast; files without any have 0, an empty list and null."""
    churn = history.churn(commits).withColumnRenamed("commits", "churn")
    best = history.top_authors(commits).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "author", "commits"))).alias("x"))
    best = best.select("path", F.transform("x", lambda a: F.struct(a["author"].alias("name"), a["commits"].alias("commits"))).alias("authors"))
    out = files
    for more in (graph.dependents(edges).withColumnRenamed("node", "path"), churn, best, blast.withColumnRenamed("node", "path")):
        out = out.join(more, "path", "left")
    return out.fillna(0, ["dependents", "churn", "blast"]).withColumn("authors", F.coalesce("authors", F.array().cast("array<struct<name:string,commits:bigint>>")))


def metrics(files: DataFrame, edges: DataFrame, findings: DataFrame, looped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(path, parsed, ...) and edges -> dead files(path), nodes of high fan-out, and the one-row score. Penalties count all rows."""
    parsed = files.where("parsed")
    dead = graph.dead(parsed.select(F.col("path").alias("node")), edges, is_entry(F.col("node"))).withColumnRenamed("node", "path")
    fan_out = graph.dependencies(edges).where(F.col("dependencies") >= HIGH_FANOUT).orderBy(F.desc("dependencies"), "node").limit(20)
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    facts = one(parsed, "parsed")
    for more in (one(dead, "dead"), one(looped, "in_cycles"), one(edges, "edges"), security.summary(findings)):
        facts = facts.join(F.broadcast(more))  # one row each
    return dead, fan_out, health.health(facts.withColumn("average", F.round(F.col("edges") / F.greatest("parsed", F.lit(1)), 2)))


def analyze(raw: DataFrame, commits: DataFrame, go_module: str | None = None, previous: Previous | None = None, max_files: int = git.MAX_FILES) -> Analysis:
    """raw(path, bytes, content) of one repository and its commits(path, author, sha, ts, ordinal) -> Analysis.

    Files that `previous` has with the same hash keep its symbols, edges, findings and externals; the others are read.
    Edges and externals of files that are gone are dropped.
    """
    files = checkpointed(inventory.inventory(raw))
    readable = files.where(inventory.is_readable(F.col("hash"), F.col("loc")))
    fresh, reused = readable, readable.select("path", "hash").limit(0)
    if previous:
        fresh = incremental.changed(readable, previous.files)
        reused = incremental.reused(readable, previous.files).select("path", "hash")
    source = raw.select("path", texts.utf8(F.col("content")).alias("text")).join(fresh.select("path", "language", "parsed"), "path")
    lines = parsing.lines_of(source)
    code = checkpointed(syntax.read(source.where("parsed")))
    found = security.findings(lines)
    symbols, engine = syntax.symbols(code), syntax.engines(code)
    old = {}
    if previous:
        kept = reused.select("path")
        symbols = symbols.unionByName(previous.symbols.join(kept, "path", "left_semi").select(*symbols.columns))
        found = found.unionByName(previous.findings.join(kept, "path", "left_semi").select(*found.columns))
        engine = engine.unionByName(previous.files.join(kept, "path", "left_semi").where("engine is not null").select("path", "engine"))
        old["reused_edges"] = previous.edges.join(kept.withColumnRenamed("path", "src"), "src", "left_semi").select("src", "dst", "kind", "line", "confidence")
        old["reused_externals"] = previous.file_externals.join(kept, "path", "left_semi").select("path", "specifier", "count")
    made = resolve.build_graph(syntax.imports(code), files, go_module, **old)
    edges, found = checkpointed(made.edges), checkpointed(found)
    looped = checkpointed(graph.cycles(edges))
    dead, fan_out, score = metrics(files, edges, found, looped)
    whole = insights(files.join(engine, "path", "left"), edges, commits, graph.blast_radius(edges))
    spots = history.hotspots(whole.where("parsed").select("path", "loc", "churn", "dependents"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("commits") == 0, "no history could be read, so hotspots and owners are empty"),
            F.when(F.col("files") >= max_files, "the repository is larger than the limit; only the first files were read"),
        )
    )
    warnings = commits.agg(F.countDistinct("sha").alias("commits")).join(F.broadcast(files.agg(F.count("*").alias("files")))).select(F.explode(notes).alias("warning"))  # one row each
    engines = engine.groupBy("engine").agg(F.count("*").alias("files"))
    return Analysis(whole, inventory.totals(files), edges, made.external, made.external_by_file, made.unresolved, symbols, found, graph.cycle_list(looped), dead.orderBy("path").limit(200), spots, fan_out, score, engines, reused, warnings)


def analyze_folder(spark: SparkSession, root: str, previous: Previous | None = None) -> Analysis:
    """The analysis of a repository in a folder that executors see."""
    raw = checkpointed(git.tree(spark, root))
    return analyze(raw, git.history(spark, root), git.go_module(raw), previous)
