"""Release notes: Markdown files with a head of `key: value` lines, `##` sections, and bullets that may go on over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeterra.functions.regexes import portable

#: Section names that a note may have.
HEADINGS = ("Added", "Changed", "Fixed", "Removed", "Security", "Known issues")
_HEAD = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of a folder's Markdown files."""
    return spark.read.text(f"{folder}/*.md", wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def parse(files: DataFrame, headings: tuple[str, ...] = HEADINGS) -> DataFrame:
    """files(source, text) -> (source, version, date, title, sections array<struct<heading, items>>, error).

    error says why a note can't be used: no head, no version, date or title, or an unknown heading; else it is null.
    Sections stand in order, those without items too. A bullet takes the indented lines below it.
    """
    head = F.regexp_extract("text", _HEAD, 1)
    values = {k: F.trim(F.regexp_extract(head, rf"(?m)^[\x20\t]*{k}[\x20\t]*:(.*?)\r?$", 1)) for k in ("version", "date", "title")}
    body = F.regexp_replace("text", _HEAD, "")
    lines = files.select("source", F.posexplode(F.split(body, r"\r?\n", -1)).alias("line", "raw"))
    name = F.regexp_extract("raw", portable(r"^##\s+(.+?)\s*$"), 1)
    bullet = F.when(F.col("raw").rlike(portable(r"^[-*]\s+(.*)$")), F.trim(F.regexp_extract("raw", portable(r"^[-*]\s+(.*)$"), 1)))
    more = F.when(F.col("raw").rlike(portable(r"^\s+(\S.*)$")), F.trim("raw"))
    order = Window.partitionBy("source").orderBy("line")
    marked = lines.withColumn("heading", F.when(name != "", name)).withColumn("section", F.count("heading").over(order)).where("section > 0")
    own = Window.partitionBy("source", "section").orderBy("line")
    marked = marked.withColumn("bullet", F.when(F.col("heading").isNull(), bullet)).withColumn("more", F.when(F.col("heading").isNull() & F.col("bullet").isNull(), more))
    marked = marked.withColumn("item", F.count("bullet").over(own))
    items = marked.where("item > 0").groupBy("source", "section", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("bullet", "more").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    items = items.groupBy("source", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "t"))), lambda x: x["t"]).alias("items"))
    names = marked.where("heading is not null").select("source", "section", "heading").join(items, ["source", "section"], "left")
    one = F.struct("section", "heading", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    sections = names.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["heading"].alias("heading"), x["items"].alias("items"))).alias("sections"))
    out = files.select("source", F.col("text").rlike(_HEAD).alias("headed"), *[v.alias(k) for k, v in values.items()]).join(sections, "source", "left")
    out = out.withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<heading:string,items:array<string>>>")))
    unknown = F.filter("sections", lambda x: ~x["heading"].isin(*headings))
    error = F.when(~F.col("headed"), "no head").when(F.size(unknown) > 0, F.concat(F.lit("unknown heading "), F.get(unknown, 0)["heading"]))
    for k in values:
        error = error.when(F.col(k) == "", f"no {k}")
    return out.select("source", *values, "sections", error.alias("error"))


def version_key(version: Column) -> Column:
    """Three numbers to order versions by; missing ones are 0."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 3)), 1, 3)


def plain_version(version: Column) -> Column:
    """Without a leading v."""
    return F.regexp_replace(version, "^v", "")


def build_label(version: Column, built_at: Column, sha: Column) -> Column:
    """v<version> · <day> · <short commit>; without a day or a commit, what there is."""
    day = F.substring(F.when(F.trim(built_at) != "", F.trim(built_at)), 1, 10)
    commit = F.coalesce(F.substring(F.when(F.trim(sha) != "", F.trim(sha)), 1, 7), F.lit("dev"))
    return F.concat_ws(" · ", F.concat(F.lit("v"), F.coalesce(F.when(F.trim(version) != "", F.trim(version)), F.lit("0.0.0-dev"))), day, commit)


def changes(sections: Column) -> Column:
    return F.aggregate(sections, F.lit(0), lambda n, x: n + F.size(x["items"])).cast("long")


def changelog(notes: DataFrame) -> DataFrame:
    """One row, text: all notes without error, the latest version first. A project's notes are few; they meet in one row."""
    lines = lambda xs: F.array_join(xs, "\n")
    section = lambda x: F.concat(F.lit("### "), x["heading"], F.lit("\n\n"), lines(F.transform(x["items"], lambda i: F.concat(F.lit("- "), i))), F.when(F.size(x["items"]) > 0, "\n").otherwise(""))
    note = F.concat(F.lit("## v"), "version", F.lit(" — "), "title", F.lit("\n\nDate "), "date", F.lit("\n\n"), lines(F.transform("sections", section)))
    rows = notes.where("error is null").agg(F.reverse(F.array_sort(F.collect_list(F.struct(version_key(F.col("version")).alias("k"), "version", note.alias("t"))))).alias("x"))
    return rows.select(F.concat(F.regexp_replace(F.concat(F.lit("# Changelog\n\n"), F.array_join(F.transform("x", lambda r: r["t"]), "\n")), r"\s+\z", ""), F.lit("\n")).alias("text"))
