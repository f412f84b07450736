"""Import resolution: candidate paths in order of preference, joined with the known files; the first hit wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.functions import paths
from codeterra.functions.regexes import portable
from codeterra.operators import graph, incremental
from codeterra.session import checkpointed

# Extensions tried by language, in order.
TRIED = {
    "typescript": (".ts", ".tsx", ".d.ts", ".js", ".mjs", ".cjs", ".json",),
    "tsx": (".tsx", ".ts", ".js", ".jsx", ".json",),
    "javascript": (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".json",),
    "python": (".py", ".pyi",),
    "go": (".go",),
    "rust": (".rs",),
    "ruby": (".rb",),
    "php": (".php",),
    "vue": (".vue", ".ts", ".js",),
    "svelte": (".svelte", ".ts", ".js",),
}
# Confidences of an exact path, with extension, index, package and module files, Go packages, includes; alias roots with what they take off.
EXACT, EXTENSION, INDEX, PACKAGE, MODULE = 1.0, 0.9, 0.85, 0.85, 0.8
GO_PACKAGE, INCLUDE = 0.9, 0.5
ALIASES = (("", 0.3), ("src/", 0.3), ("app/", 0.35))
#: Pairs of an importer and a file of its package that a task makes, about, and the most such tasks.
PAIRS, MOST_TASKS = 1_000_000, 10_000


def _tries(language: Column) -> Column:
    """array<struct<suffix, confidence>> for a language."""
    rows = None
    for name, exts in TRIED.items():
        tries = [("", EXACT), *((e, EXTENSION) for e in exts)]
        for e in exts:
            tries += [("/index" + e, INDEX), ("/__init__" + e, PACKAGE), ("/mod" + e, MODULE)]
        column = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(c).alias("confidence")) for s, c in tries])
        rows = F.when(language == name, column) if rows is None else rows.when(language == name, column)
    return rows.otherwise(F.array(F.struct(F.lit("").alias("suffix"), F.lit(EXACT).alias("confidence"))))


def bases(path: Column, specifier: Column, language: Column) -> Column:
    """array<struct<base, less>>: the places a specifier may mean, by the first rule that fits: relative, Python's dots, Python's dotted names, aliases."""
    folder = paths.directory_of(path)
    none = F.expr("cast(array() as array<struct<base:string,less:double>>)")
    one = lambda base, less=0.0: F.struct(paths.normalize(base).alias("base"), F.lit(less).alias("less"))
    dots = F.length(F.regexp_extract(specifier, r"^\.+", 0))
    names = F.regexp_replace(F.regexp_replace(specifier, r"^\.+", ""), r"\.", "/")
    alias = F.regexp_extract(specifier, r"^[@~]/(.*)$", 1)
    dotted = F.regexp_replace(specifier, r"\.", "/")
    return (
        F.when(specifier == "", none)
        .when(specifier.rlike(r"^\.\.?/"), F.array(one(F.concat_ws("/", folder, specifier))))
        .when((language == "python") & specifier.startswith("."), F.array(one(F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int")), names))))
        .when(language == "python", F.array(one(dotted), one(F.concat(F.lit("src/"), dotted), 0.2)))
        .when(specifier.rlike("^[@~]/"), F.array(*[one(F.concat(F.lit(root), alias), less) for root, less in ALIASES]))
        .otherwise(none)
    )


def _last(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _found(imports: DataFrame, files: DataFrame, go_module: str | None) -> DataFrame:
    """Imports' columns, target, confidence, outcome, package: a row for each import. One of a Go package has its folder as package and no target yet."""
    keys = ["path", "specifier", "language"]
    blanks = portable(r"^\s+|\s+$")
    imports = imports.withColumn("specifier", F.regexp_replace("specifier", blanks, "")).where("specifier <> ''")
    asked = imports.select(*keys).distinct()
    every = F.flatten(F.transform(bases(F.col("path"), F.col("specifier"), F.col("language")), lambda b: F.transform(_tries(F.col("language")), lambda t: F.struct(F.concat(b["base"], t["suffix"]).alias("target"), (t["confidence"] - b["less"]).alias("confidence")))))
    tried = asked.select(*keys, F.posexplode(every).alias("ordinal", "x")).select(*keys, "ordinal", "x.target", "x.confidence")
    known = files.select(F.col("path").alias("target")).distinct()
    hits = tried.join(known.hint("shuffle_hash"), "target")  # the tries, many to an import, are not sorted
    best = hits.groupBy(*keys).agg(F.min_by(F.struct("target", "confidence"), "ordinal").alias("hit"))
    other = (F.col("specifier") != "") & (F.coalesce("language", F.lit("")) != "python") & ~F.col("specifier").rlike(r"^(\.\.?|[@~])/")
    joined = imports.join(best, keys, "left").withColumn("package", F.lit(None).cast("string"))
    # rows that a join has nothing for are joined by their own paths: nulls would all meet in one task
    apart = F.concat(F.lit("//"), "path")
    if go_module:
        in_module = other & F.col("specifier").startswith(f"{go_module}/") & F.col("language").isNotNull()
        folders = _go_files(known).select(F.col("folder").alias("asked"), F.col("folder").alias("package")).distinct()
        asked_folder = F.when(in_module, paths.normalize(F.substring("specifier", len(go_module) + 2, 1 << 30))).otherwise(apart)
        joined = joined.drop("package").withColumn("asked", asked_folder).join(folders, "asked", "left").withColumn("package", F.when(in_module, F.col("package"))).drop("asked")
        other &= ~F.col("specifier").startswith(f"{go_module}/")
    if "kind" in imports.columns:
        # only base names that a single file has
        single = known.groupBy(_last(F.col("target")).alias("base")).agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
        single = single.select("base", F.struct("target", F.lit(INCLUDE).alias("confidence")).alias("included"))
        included = other & (F.col("kind") == "include")
        joined = joined.withColumn("base", F.when(included, _last(F.col("specifier"))).otherwise(apart)).join(single, "base", "left").withColumn("hit", F.coalesce("hit", F.when(included, F.col("included"))))
    outcome = F.when(F.col("hit.target") == F.col("path"), "self").when(F.col("hit").isNotNull() | F.col("package").isNotNull(), "resolved").when(F.col("specifier").rlike("^[./]"), "unresolved").otherwise("external")
    return joined.select(*imports.columns, F.col("hit.target").alias("target"), F.round("hit.confidence", 2).alias("confidence"), outcome.alias("outcome"), "package")


def _go_files(known: DataFrame) -> DataFrame:
    return known.where(F.col("target").endswith(".go")).withColumn("folder", paths.directory_of(F.col("target")))


def _packages(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(package, ...) with target, once for each Go file of the folder.

    That is as many rows as importers times files of each folder. A folder of many is dealt to as many tasks as it has PAIRS,
    and what comes out of that join is not moved.
    """
    sources = _go_files(files.select(F.col("path").alias("target")).distinct()).withColumnRenamed("folder", "package")
    sizes = rows.groupBy("package").agg(F.count("*").alias("n")).join(sources.groupBy("package").agg(F.count("*").alias("m")), "package")
    sizes = checkpointed(sizes.select("package", (F.col("n") * F.col("m")).alias("pairs"), (F.floor(F.col("n") * F.col("m") / PAIRS) + 1).alias("tasks")))
    tasks = min(MOST_TASKS, 1 + (sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS)
    dealt = rows.join(sizes, "package").withColumn("task", F.pmod(F.xxhash64(*rows.columns), "tasks")).drop("tasks", "pairs")
    copied = sources.join(sizes, "package").select("package", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
    keys = ["package", "task"]
    return dealt.repartition(tasks, *keys).join(copied.repartition(tasks, *keys).hint("merge"), keys).drop("task")


def resolve(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """imports(path, language, specifier, line, kind), files(path) -> imports' columns, target, confidence, outcome.

    An import that starts with go_module and `/` is a row for each .go file of that folder. One of kind `include` that no
    other rule takes is the only file of its base name.

    Specifiers are trimmed; blank ones are skipped. outcome is resolved, unresolved (starts with `.` or `/`), or external; a resolved import of the file itself is `self`.
    Each import meets only its own candidates, by an equi-join on the path.
    """
    found = _found(imports, files, go_module)
    if not go_module:
        return found.drop("package")
    found = checkpointed(found)
    whole = _packages(found.where("package is not null").drop("target"), files).withColumns({"confidence": F.lit(GO_PACKAGE), "outcome": F.when(F.col("target") == F.col("path"), "self").otherwise("resolved")})
    return found.where("package is null").drop("package").unionByName(whole.drop("package"))


@dataclass
class Graph:
    edges: DataFrame  # src, dst, kind, line, confidence
    external: DataFrame  # specifier, count
    external_by_file: DataFrame  # path, specifier, count
    unresolved: DataFrame  # one row, unresolved


def build_graph(imports: DataFrame, files: DataFrame, go_module: str | None = None, reused_edges: DataFrame | None = None, reused_externals: DataFrame | None = None) -> Graph:
    """The dependency graph of imports(path, language, specifier, line, kind) among files(path), with what unchanged files still tell.

    Edges have no self loops, and of those with one (src, dst, kind) the first. Reused edges and externals(path, specifier,
    count) stay as far as their files exist, after all fresh ones.
    """
    resolved = _found(imports, files, go_module)
    if go_module:
        resolved = checkpointed(resolved)
    fresh = graph.first_edges(resolved.where("outcome = 'resolved' and package is null").select(F.col("path").alias("src"), F.col("target").alias("dst"), "kind", "line", "confidence"))
    counts = external_by_file(resolved)
    if go_module:
        fresh = _with_packages(fresh, resolved.where("package is not null"), files)
    if reused_edges is not None:
        fresh = incremental.merged_edges(fresh, incremental.live_edges(reused_edges, files)).drop("old")
    if reused_externals is not None:
        counts = incremental.merged_counts(counts, reused_externals.join(files.select("path").distinct(), "path", "left_semi"), "path", "specifier")
    external = counts.groupBy("specifier").agg(F.sum("count").alias("count"))
    return Graph(fresh, external, counts, resolved.agg(F.count(F.when(F.col("outcome") == "unresolved", 1)).alias("unresolved")))


def _with_packages(single: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """First edges and those of whole Go packages; of two with one (src, dst, kind) that of the lower line. Settled before files take the place of folders."""
    keys = ["src", "kind", "package"]
    every = resolved.groupBy(F.col("path").alias("src"), "kind", "package").agg(F.min("line").alias("first"))
    folder = F.when(F.col("dst").endswith(".go"), paths.directory_of(F.col("dst"))).otherwise(F.concat(F.lit("//"), "dst"))
    both = single.withColumn("package", folder).join(every, keys, "left").where("first is null or line <= first")
    taken = both.where("first is not null").groupBy(*keys).agg(F.collect_list("dst").alias("taken"))  # imports of one file
    whole = _packages(every.join(taken, keys, "left"), files).withColumnRenamed("target", "dst")
    whole = whole.where("src <> dst and (taken is null or not array_contains(taken, dst))")
    return both.select(*single.columns).unionByName(whole.select("src", "dst", "kind", F.col("first").alias("line"), F.lit(GO_PACKAGE).alias("confidence")))


def external_by_file(resolved: DataFrame) -> DataFrame:
    return resolved.where("outcome = 'external'").groupBy("path", "specifier").agg(F.count("*").alias("count"))


def external_counts(resolved: DataFrame) -> DataFrame:
    return resolved.where("outcome = 'external'").groupBy("specifier").agg(F.count("*").alias("count"))
