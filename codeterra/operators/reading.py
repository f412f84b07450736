"""A reading path: which files to read first, in which order, and what is said of each without a model; prompts for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeterra.operators import graph
from codeterra.operators.grounding import CLAIMS

LEAST, MOST = 7, 15


def steps(facts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """facts(node, level, dependents, blast, churn, entry) -> (step, node, level, importance): the chosen nodes in reading order.

    Reading order is by level, then node. Of up to `least` nodes all are chosen; else the most important ones, a twelfth
    of all, but no less than `least` and no more than `most`; equally important ones in reading order.
    """
    scored = facts.select("node", "level", graph.importance(facts).cast("double").alias("importance"))
    n = scored.agg(F.count("*").alias("n"))
    target = F.when(F.col("n") <= least, F.col("n")).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("n") / 12 + 0.5))))
    best = scored.orderBy(F.desc("importance"), "level", "node").limit(max(least, most)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "level", "node")))
    best = best.join(F.broadcast(n), F.col("rank") <= target)  # one row; `most` rows at most
    return best.select(F.row_number().over(Window.orderBy("level", "node")).alias("step"), "node", "level", "importance")


def candidates(files: DataFrame, edges: DataFrame, entry: Column) -> DataFrame:
    """files(path, language, loc, dependents, blast, churn, skip_reason) -> what a reading path is chosen from: readable files, with how many they use."""
    uses = graph.dependencies(edges).withColumnRenamed("node", "path")
    rows = files.where("skip_reason is null and loc > 0").join(uses, "path", "left")
    return rows.select("path", "language", "loc", "dependents", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), "blast", "churn", entry.alias("entry"))


def order(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """facts(path, ...) with node and level: the reading order among these files, edges to others aside; files without edges come first."""
    among = graph.within(edges.select("src", "dst"), facts.select(F.col("path").alias("node")))
    return facts.withColumnRenamed("path", "node").join(graph.reading_levels(among), "node", "left").fillna(0, ["level"])


def cite(text: Column, path: Column, line: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.array(F.struct(path.alias("path"), line.cast("long").alias("line"))).alias("citations"))).cast(CLAIMS)


def why(dependents: Column, dependencies: Column, entry: Column, path: Column) -> Column:
    """What measured numbers say of a step."""
    begins = F.concat(F.lit("This file looks like a place where the program begins; it uses "), dependencies.cast("string"), F.lit(" other files"))
    used = F.concat(dependents.cast("string"), F.lit(" files depend on this one; those that follow are easier after it"))
    return cite(F.when(entry, begins).otherwise(used), path, F.lit(1))


def reading_path(chosen: DataFrame, facts: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """steps() and facts(node, dependents, dependencies, entry) -> (step, node, why, look_for).

    replies(step, why, look_for) are a model's grounded claims, by place; they explain and never reorder. A step without
    any says what was measured.
    """
    rows = chosen.select("step", "node").join(facts.select("node", "dependents", "dependencies", "entry"), "node")
    own = why(F.col("dependents"), F.col("dependencies"), F.col("entry"), F.col("node").cast("string"))
    none = F.array().cast(CLAIMS)
    if replies is None:
        return rows.select("step", "node", own.alias("why"), none.alias("look_for"))
    rows = rows.join(replies.select("step", F.col("why").alias("said"), F.col("look_for").alias("seen")), "step", "left")
    return rows.select("step", "node", F.when(F.size("said") > 0, F.col("said")).otherwise(own).alias("why"), F.coalesce("seen", none).alias("look_for"))


def describe(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files(path, language, bytes, loc, dependents, skip_reason), symbols(path, line, name, kind) -> (path, headline, points): a summary from facts alone."""
    declared = symbols.groupBy("path").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))), 1, 3).alias("first"))
    rows = files.join(declared, "path", "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    size = text(F.coalesce("language", F.lit("unknown")), " file of ", F.col("loc"), " lines")
    headline = F.when(F.col("skip_reason").isNotNull(), text("Not read: ", F.col("skip_reason"))).when(F.col("n") > 0, text(size, ", ", F.col("n"), " declared")).otherwise(size)
    names = F.transform("first", lambda s: F.struct(F.concat(s["kind"], F.lit(" "), s["name"]).alias("text"), F.array(F.struct(F.col("path").alias("path"), s["line"].cast("long").alias("line"))).alias("citations"))).cast(CLAIMS)
    skipped = cite(text(F.col("bytes"), " bytes, named by ", F.col("dependents"), " files"), F.col("path"), F.lit(1))
    plain = cite(text(F.col("loc"), " lines, used by ", F.col("dependents"), " files"), F.col("path"), F.lit(1))
    return rows.select("path", headline.alias("headline"), F.when(F.col("skip_reason").isNotNull(), skipped).when(F.col("n") > 0, names).otherwise(plain).alias("points"))


def describe_modules(summaries: DataFrame, module: Column) -> DataFrame:
    """(module, files, headline, points) of summaries(path, headline, points): the members' number, and the first three members with their anchors."""
    first = F.get(F.get(F.col("points"), 0)["citations"], 0)
    anchor = F.coalesce(first, F.struct(F.col("path").alias("path"), F.lit(1).cast("long").alias("line")))
    rows = summaries.select(module.alias("module"), "path", F.concat("path", F.lit(" — "), "headline").alias("text"), anchor.alias("at"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy("path"))
    three = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("path", "text", "at")))), lambda x: F.struct(x["text"].alias("text"), F.array(x["at"]).alias("citations"))).cast(CLAIMS)
    out = rows.withColumn("rank", rank).groupBy("module").agg(F.count("*").alias("files"), three.alias("points"))
    return out.select("module", "files", F.concat(F.lit("This folder holds "), F.col("files").cast("string"), F.lit(" files")).alias("headline"), "points")


def scopes(files: DataFrame, modules: DataFrame, repo: DataFrame) -> DataFrame:
    """Summaries of all three scopes, (scope, key, headline, points)."""
    of = lambda rows, scope, key: rows.select(F.lit(scope).alias("scope"), F.col(key).alias("key"), "headline", "points")
    return of(files, "file", "path").union(of(modules, "module", "module")).union(repo.select(F.lit("repo").alias("scope"), F.lit(".").alias("key"), "headline", "points"))


def model_files(files: DataFrame, most: int = 400) -> DataFrame:
    """The readable files that most depend on, ties by path: what a model is shown."""
    return files.where("skip_reason is null and loc > 0 and bytes > 0").orderBy(F.desc("dependents"), "path").limit(most)


def model_modules(modules: DataFrame, most: int = 30) -> DataFrame:
    return modules.orderBy(F.desc("files"), "module").limit(most)


def _bullets(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))


def _listed(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, 15), ", ")).otherwise(F.lit(none))


def file_prompt(path: Column, language: Column, numbered: Column, symbols: Column, dependents: Column, dependencies: Column) -> Column:
    """The prompt on one file; symbols array<struct<name, kind, line>>, 60 at most are shown, and 15 neighbours a side."""
    declared = F.transform(F.slice(symbols, 1, 60), lambda s: F.concat(F.lit("line "), s["line"].cast("string"), F.lit(": "), s["kind"], F.lit(" "), s["name"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.concat(F.lit("Language: "), F.coalesce(language, F.lit("unknown"))),
        F.lit("\nDeclared in this file:"),
        _bullets(declared, "- nothing was found"),
        F.concat(F.lit("\nFiles that depend on it: "), _listed(dependents, "none")),
        F.concat(F.lit("Files that it uses: "), _listed(dependencies, "none")),
        F.lit("\nContent (the number before the tab is the line):"),
        numbered,
        F.lit('\nAnswer with JSON of this form:\n{"headline":"one sentence","points":[{"text":"one observation","lines":[12]}]}\nAt most 4 points, each with a line of this file that bears it out.'),
    )


def module_prompt(module: Column, files: Column) -> Column:
    """files array<struct<path, headline, line>>: 80 at most."""
    shown = F.transform(F.slice(files, 1, 80), lambda x: F.concat(x["path"], F.lit(" (line "), x["line"].cast("string"), F.lit("): "), x["headline"]))
    return F.concat_ws("\n", F.concat(F.lit("Folder: "), module), F.lit("\nIts files:"), _bullets(shown, "- none"), F.lit('\nAnswer with JSON of this form:\n{"headline":"one sentence","points":[{"text":"one observation","refs":[{"path":"a","line":1}]}]}'))


def question_prompt(question: Column, evidence: Column, history: Column) -> Column:
    """evidence array<struct<path, line, text>>; history array<struct<question, answer>>, oldest first."""
    shown = F.transform(evidence, lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"), F.lit(" "), x["text"]))
    before = F.transform(history, lambda x: F.concat(x["question"], F.lit(" -> "), x["answer"]))
    return F.concat_ws("\n", F.lit("Evidence:"), _bullets(shown, "- none"), F.lit("\nAsked before:"), _bullets(before, "- nothing"), F.concat(F.lit("\nQuestion: "), question), F.lit('\nAnswer with JSON of this form:\n{"claims":[{"text":"one claim","refs":[{"path":"a","line":1}]}]}'))


def short_answer(claims: Column) -> Column:
    """An answer's claims as one line, for the next question's history."""
    return F.when(F.size(claims) > 0, F.array_join(F.transform(claims, lambda c: c["text"]), " ")).otherwise("no grounded answer")
