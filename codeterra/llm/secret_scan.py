"""Secret scans over a blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger row holds, for a blob, which rules
(kind and version) have scanned it and the spans they found. A scan takes each distinct blob once, and of its rules only
those the ledger doesn't list; findings are then joined back to all paths that have the blob. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.llm.lineage import free


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; one whose group has fewer than least characters is dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


# The rules. A run of the class is matched whole, so a lower bound on it in the pattern drops what is too short.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MARK = "[secret]"
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_NONE = f"cast(array() as {_SPANS})"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points: matches alternate with the gaps that split() leaves, so lengths add up to places."""
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = (lambda w: F.length(F.regexp_extract(w, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda w: w.isNotNull())
    steps = F.zip_with(F.split(text, rule.pattern, -1), match, lambda gap, w: F.struct(F.length(gap).cast("long").alias("gap"), F.coalesce(F.length(w), F.lit(0)).cast("long").alias("size"), (w.isNotNull() & long_enough(w)).alias("ok")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["ok"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(_SPANS).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), F.expr(_NONE).alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(_NONE))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions(text) and a ledger(blob, rules, spans), if there is one -> ledger rows of what the ledger lacks.

    A row per blob with unseen rules: blob, the rules now run, and their spans(start, rank, kind, end) in order. A null
    text is the empty blob. No versions give no rows. To go on, append the rows to the ledger; a blob may have several.
    """
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("unseen", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = F.array_except(every, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        blobs = blobs.join(seen, "blob", "left").withColumn("unseen", unseen).where(F.size("unseen") > 0)
    found = [F.when(F.array_contains("unseen", r.name), spans(F.col("text"), r, k)).otherwise(F.expr(_NONE)) for k, r in enumerate(rules)]
    return blobs.select("blob", F.col("unseen").alias("rules"), F.array_sort(F.concat(*found)).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, into: str = "spans") -> DataFrame:
    """All columns of versions with one more, into: what the ledger has on each row's text, for every row.

    Only blobs with findings are joined; a column of that name in versions is replaced.
    """
    blob, found = free("blob", versions.columns), free("found", versions.columns)
    held = ledger.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias(found))
    rows = versions.drop(into).withColumn(blob, blob_of(F.col("text")))
    return rows.join(held, blob, "left").withColumn(into, F.coalesce(found, F.expr(_NONE))).drop(blob, found)


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, mark: str = MARK) -> Column:
    """text with each run of overlapping or touching spans replaced by the mark; found must be sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] > acc["to"]
        runs = F.when(new, F.concat(acc["runs"], F.array(F.struct(acc["to"].alias("after"), s["start"].alias("start"))))).otherwise(acc["runs"])
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), runs.cast("array<struct<after:bigint,start:bigint>>").alias("runs"))

    start = F.struct(F.lit(-1).cast("long").alias("to"), F.expr("cast(array() as array<struct<after:bigint,start:bigint>>)").alias("runs"))
    runs = F.aggregate(found, start, step, lambda acc: F.concat(acc["runs"], F.array(F.struct(acc["to"].alias("after"), F.length(text).cast("long").alias("start")))))
    parts = F.transform(runs, lambda r: F.substring(text, (F.greatest(r["after"], F.lit(0)) + 1).cast("int"), (r["start"] - F.greatest(r["after"], F.lit(0))).cast("int")))
    return F.when(F.size(found) > 0, F.array_join(parts, mark)).otherwise(text)
