"""One analysis as a Markdown report and as JSON: each section is one row made of a bounded list, and the rows are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a section.
LANGUAGES, HOTSPOTS, CYCLES, DEAD, FINDINGS, EXTERNALS = 10, 15, 10, 30, 50, 20
#: Rows of the JSON export.
EXPORT_FILES, EXPORT_EDGES, EXPORT_FINDINGS = 5000, 5000, 500


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def section(rows: DataFrame, name: str, heading: str, line: Column, order: list[Column], most: int | None, before: str = "") -> DataFrame:
    """One row with column `name`: heading, what stands before, and a line for each of the first rows, or of all; null without rows."""
    first = rows.select(line.alias("line"), F.struct(*order).alias("by"))
    first = first if most is None else first.orderBy("by").limit(most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("by", "line"))), lambda x: x["line"]), "\n")
    return first.agg(F.when(F.count("*") > 0, _text(f"## {heading}\n\n{before}", text, "\n")).alias(name))


def cited(claim: Column) -> Column:
    """A claim with its places in brackets."""
    places = F.array_join(F.transform(claim["citations"], lambda c: _text(c["path"], ":", c["line"])), ", ")
    return F.when(F.size(claim["citations"]) > 0, _text(claim["text"], " (`", places, "`)")).otherwise(claim["text"])


def claim_list(claims: Column, none: str) -> Column:
    return F.when(F.size(claims) > 0, F.array_join(F.transform(claims, lambda c: _text("- ", cited(c))), "\n")).otherwise(f"_{none}_")


def languages(rows: DataFrame) -> DataFrame:
    """rows(language, files, loc)"""
    return section(rows, "languages", "Languages", _text("| ", F.col("language"), " | ", F.col("files"), " | ", F.col("loc"), " |"), [-F.col("loc"), -F.col("files"), F.col("language")], LANGUAGES, "| Language | Files | Lines |\n| --- | --- | --- |\n")


def hotspots(rows: DataFrame) -> DataFrame:
    """rows(path, churn, loc, dependents, risk)"""
    line = _text("| `", F.col("path"), "` | ", F.col("churn"), " | ", F.col("loc"), " | ", F.col("dependents"), " |")
    return section(rows, "hotspots", "Hotspots", line, [-F.col("risk"), F.col("path")], HOTSPOTS, "Large files that change often and that many depend on.\n\n| File | Changes | Lines | Dependents |\n| --- | --- | --- | --- |\n")


def cycles(rows: DataFrame) -> DataFrame:
    """rows(cycle, size, nodes)"""
    return section(rows, "cycles", "Dependency cycles", _text("- ", F.array_join(F.transform("nodes", lambda n: _text("`", n, "`")), " → ")), [-F.col("size"), F.col("cycle")], CYCLES)


def dead(rows: DataFrame) -> DataFrame:
    """rows(path)"""
    return section(rows, "dead", "Code that nothing uses", _text("- `", F.col("path"), "`"), [F.col("path")], DEAD)


def findings(rows: DataFrame) -> DataFrame:
    """rows(path, line, rule, severity, message)"""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    line = _text("- **[", F.col("severity"), "]** `", F.col("path"), ":", F.col("line"), "` — ", F.col("message"))
    return section(rows, "findings", "Security findings", line, [rank, F.col("path"), F.col("rule"), F.col("line")], FINDINGS, "_Found by patterns; this is no audit._\n\n")


def externals(rows: DataFrame) -> DataFrame:
    """rows(specifier, count)"""
    return section(rows, "externals", "Most used packages", _text("- ", F.col("specifier"), " — ", F.col("count"), " times"), [-F.col("count"), F.col("specifier")], EXTERNALS)


def digest(row: DataFrame) -> DataFrame:
    """row(headline, purpose, stack, entrypoints, how_to_run, notes) of at most one row"""
    parts = (("What it does", "purpose"), ("What it is made with", "stack"), ("Where to begin", "entrypoints"), ("How to run it", "how_to_run"), ("Notes", "notes"))
    text = _text("## Overview\n\n", F.col("headline"), "\n", *[x for name, c in parts for x in (f"\n### {name}\n\n", claim_list(F.col(c), "nothing grounded yet"), "\n")])
    return row.agg(F.first(text).alias("digest"))


def modules(rows: DataFrame) -> DataFrame:
    """rows(module, headline, points)"""
    line = _text("### ", F.when(F.col("module") == ".", "root").otherwise(F.col("module")), "\n\n", F.col("headline"), "\n\n", claim_list(F.col("points"), "nothing grounded yet"), "\n")
    return section(rows, "modules", "What each folder is for", line, [F.col("module")], None)


def reading(rows: DataFrame) -> DataFrame:
    """rows(step, node, why, look_for)"""
    more = F.when(F.size("look_for") > 0, _text("\n\n**Look for**\n\n", claim_list(F.col("look_for"), "nothing"))).otherwise("")
    line = _text("### ", F.col("step"), ". `", F.col("node"), "`\n\n", claim_list(F.col("why"), "no reason given"), more, "\n")
    return section(rows, "reading", "A reading path", line, [F.col("step")], None)


def summary(repo: DataFrame, totals: DataFrame, health: DataFrame) -> DataFrame:
    """One row each of repo(owner, name, host, branch, commit), totals(files, parsed, loc), health(score, grade and penalties) -> intro, health, totals."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    intro = _text("# ", F.col("owner"), "/", F.col("name"), "\n\n- Host: ", F.col("host"), "\n- Branch: ", unknown(F.col("branch")), "\n- Commit: ", unknown(F.col("commit")), "\n")
    score = _text("## Health\n\nGrade **", F.col("grade"), "** (", F.col("score"), " / 100)\n\n| Reason | Penalty |\n| --- | --- |", *[x for name in ("dead", "cycle", "coupling", "security") for x in (f"\n| {name} | ", F.col(f"{name}_penalty"), " |")], "\n")
    many = _text("## Totals\n\n- Files: ", F.col("files"), " (", F.col("parsed"), " parsed)\n- Lines: ", F.col("loc"), "\n")
    return repo.select(intro.alias("intro")).join(F.broadcast(health.select(score.alias("health")))).join(F.broadcast(totals.select(many.alias("totals"))))  # one row each


def markdown(head: DataFrame, *sections: DataFrame) -> DataFrame:
    """(report): summary()'s row and the sections' rows in the order given; sections without rows are left out. A digest goes before the score."""
    row = head
    for part in sections:
        row = row.join(F.broadcast(part))  # one row
    rest = [c for part in sections for c in part.columns if c != "digest"]
    early = [F.col("digest")] if any("digest" in part.columns for part in sections) else []
    return row.select(F.concat_ws("\n", "intro", *early, "health", "totals", *rest, F.lit("---\n\nEvery claim with a place was checked against that place.")).alias("report"))


def export(files: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row, doc: files, edges and findings as one JSON object, each bounded and in order."""

    def listed(rows: DataFrame, name: str, fields: tuple[str, ...], by: tuple[str, ...], most: int) -> DataFrame:
        first = rows.select(F.struct(*by).alias("by"), F.struct(*fields).alias("x")).orderBy("by").limit(most)
        return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "x"))), lambda r: r["x"]).alias(name))

    row = listed(files, "files", ("path", "language", "loc"), ("path",), EXPORT_FILES)
    row = row.join(F.broadcast(listed(edges, "edges", ("src", "dst", "kind"), ("src", "dst", "kind"), EXPORT_EDGES)))  # one row
    row = row.join(F.broadcast(listed(found, "findings", ("path", "line", "rule", "severity"), ("path", "rule"), EXPORT_FINDINGS)))  # one row
    return row.select(F.to_json(F.struct("files", "edges", "findings")).alias("doc"))
