"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and the beginning of a path; it fits its host, all subdomains, and paths that start so. A URL's
expressions are its host's suffixes by labels with its path's beginnings (of the lengths that are listed). Each
expression sets or tests four bits in one 64-bit block. Most URLs have no expression that passes; what passes is joined
with the list by equality, so false positives fall out and no URL meets more rows than its few expressions. The filter
has a fixed largest size: beyond it more expressions pass, and results stay the same. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.llm.lineage import free

BITS = 4
KEYS_PER_BLOCK = 4
#: Largest filter, in blocks of 8 bytes: half a megabyte goes with the plan.
MAX_BLOCKS = 1 << 16
DEFAULT = "allow"
# The rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty for null and for what has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)).cast("int")


def _mask(host: Column, path: Column) -> Column:
    h = F.xxhash64(F.lit(1), host, path)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


class BlockedBloom:
    """The filter of rules(host, path), held as one array constant of 64-bit blocks."""

    def __init__(self, rules: DataFrame):
        keys = rules.count()
        self.blocks = 1
        while self.blocks * KEYS_PER_BLOCK < keys and self.blocks < MAX_BLOCKS:
            self.blocks *= 2
        host, path = F.col("host"), F.col("path")
        rows = rules.groupBy(_block(host, path, self.blocks).alias("b")).agg(F.bit_or(_mask(host, path)).alias("m")).collect()  # at most MAX_BLOCKS rows
        masks = dict(map(tuple, rows))
        self.words = F.split(F.lit(",".join(str(masks.get(k, 0)) for k in range(self.blocks))), ",").cast("array<bigint>")

    def passes(self, host: Column, path: Column) -> Column:
        mask = _mask(host, path)
        return F.get(self.words, _block(host, path, self.blocks)).bitwiseAND(mask) == mask


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """All columns of pages(url) and host, path, rule, verdict; pages' own columns of these names are replaced.

    rules(verdict, host, path): the fitting rule of most characters gives the verdict (of equally long ones the last by
    text, then block before allow), else default. rule is null where none fits. Null hosts or paths in rules never fit;
    no rules leave all to default. Repeated pages come back repeated.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    bloom = BlockedBloom(rules)
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # distinct lengths of paths: bounded by the longest URL
    host, path = split_url(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    paths = F.transform(fit, lambda n: F.substring(F.col("path"), F.lit(1), n))
    every = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    passed = F.filter(every, lambda x: bloom.passes(x["h"], x["p"]))
    hits = pages.select("host", "path", passed.alias("passed")).where(F.size("passed") > 0).distinct().select("host", "path", F.explode("passed").alias("x"))
    named = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", F.concat("host", "path").alias("rule"))
    exact = hits.select("host", "path", "x.h", "x.p").join(named, ["h", "p"])
    top = free("best", pages.columns)
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(top))
    out = pages.join(best, ["host", "path"], "left")
    own = [F.col(f"`{c}`") for c in pages.columns]
    return out.select(*own, F.col(top)["rule"].alias("rule"), F.coalesce(F.col(top)["verdict"], F.lit(default)).alias("verdict"))
