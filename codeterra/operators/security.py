"""Pattern rules over source lines: one finding for each file and rule, at the first line that matches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.functions import paths
from codeterra.functions.regexes import portable

LONGEST_LINE = 500
WEIGHTS = {"high": 8, "medium": 3, "low": 1}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    message: str
    pattern: str
    production_only: bool = False
    languages: tuple[str, ...] = ()
    #: Texts of which each line that the pattern fits has one; in lower case, without an i (Turkish has two), where the pattern takes either case.
    signs: tuple[str, ...] = ()


# The rules' names, severities, patterns, languages and signs.
RULES = (
    Rule("hardcoded-secret", "high", "a key or password seems to be written into the code", r"""(?i)\b(?:api[_-]?key|secret|password|passwd|token|credential)\b\s*[:=]\s*['"][A-Za-z0-9_\-./+=]{16,}['"]""", True, signs=("key", "secret", "passw", "token", "credent")),
    Rule("private-key", "high", "a private key is in the file", r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----", signs=("PRIVATE KEY-----",)),
    Rule("aws-access-key", "high", "a text with the form of an AWS access key", r"\bAKIA[0-9A-Z]{16}\b", signs=("AKIA",)),
    Rule("sql-injection", "high", "SQL is joined with a variable; parameters are safer", r"""(?i)\b(?:select|insert|update|delete)\b[^;'"`\n]*['"`]\s*(?:\+|\$\{|%\s*\(|\.format\()""", True, signs=("select", "nsert", "update", "delete")),
    Rule("dangerous-eval", "medium", "code is made from text", r"\beval\s*\(|new\s+Function\s*\(", True, ("javascript", "typescript", "tsx", "python", "php", "ruby"), signs=("eval", "Function")),
    Rule("shell-injection", "medium", "a shell command is put together from variables", r"""(?:exec|execSync|spawnSync|system|popen|os\.system)\s*\([^)]*(?:\+|\$\{|%s|f['"])""", True, signs=("exec", "spawnSync", "system", "popen")),
    Rule("insecure-random", "low", "a common random number where a secret one is wanted", r"(?i)Math\.random\(\)[^\n]*\b(?:token|secret|password|key|salt|nonce)\b", signs=("random",)),
    Rule("debug-leftover", "low", "a debugging command is left in the code", r"\b(?:debugger|console\.debug|pdb\.set_trace|binding\.pry)\b", True, signs=("debug", "pdb", "binding")),
    Rule("disabled-tls", "high", "certificates are not checked", r"rejectUnauthorized\s*:\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true", signs=("rejectUnauthorized", "verify", "SkipVerify")),
)


def findings(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """lines(path, language, line, text) -> path, line, rule, severity, message, snippet: one row for each file and rule.

    A rule's pattern is tried on lines with one of its signs only, once on each.
    """
    hits = []
    for k, rule in enumerate(rules):
        fits = F.col("text").rlike(portable(rule.pattern))
        if rule.signs:
            where = F.col("folded" if rule.pattern.startswith("(?i)") else "text")
            fits = reduce(or_, [where.contains(sign) for sign in rule.signs]) & fits
        if rule.languages:
            fits = F.coalesce(F.col("language").isin(*rule.languages), F.lit(False)) & fits
        if rule.production_only:
            fits = fits & paths.is_production(F.col("path"))
        hits.append(F.when(fits, F.lit(k)))
    some = lines.where(F.length("text") <= LONGEST_LINE).withColumn("folded", F.lower("text"))
    # nulls are dropped after explode, since Spark does not compile array_compact
    some = some.withColumn("hit", F.explode(F.array(*hits))).where("hit is not null")
    first = some.groupBy("path", "hit").agg(F.min_by(F.struct("line", "text"), "line").alias("at"))
    of = lambda field: F.element_at(F.array(*[F.lit(getattr(rule, field)) for rule in rules]), F.col("hit") + 1).alias(field if field != "name" else "rule")
    return first.select("path", F.col("at.line").alias("line"), of("name"), of("severity"), of("message"), redact(F.col("at.text")).alias("snippet"))


def redact(text: Column) -> Column:
    """Quoted runs of 16 or more secret-like characters masked, PEM headers too; trimmed, at most 200 characters."""
    masked = F.regexp_replace(text, r"""(['"])([A-Za-z0-9_\-./+=]{16,})\1""", "$1[redacted]$1")
    masked = F.regexp_replace(masked, "-----BEGIN[^-]*-----", "-----BEGIN [redacted]-----")
    blanks = portable(r"\s")
    return F.substring(F.regexp_replace(masked, f"^{blanks}+|{blanks}+\\z", ""), 1, 200)


def by_severity(found: DataFrame, most: int = 200) -> DataFrame:
    """The `most` (at most 500) gravest findings, then by path, rule and line."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, "path", "rule", "line").limit(min(most, 500))


def summary(found: DataFrame) -> DataFrame:
    """One row: counts by severity and the weighted penalty."""
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in WEIGHTS]
    penalty = sum((F.count(F.when(F.col("severity") == s, 1)) * w for s, w in WEIGHTS.items()), F.lit(0)).cast("long")
    return found.agg(*counts, penalty.alias("penalty"))
