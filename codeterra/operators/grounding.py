"""Written claims and their citations: read from a model's reply, checked against the files, and kept as far as they hold."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIMS = "array<struct<text:string,citations:array<struct<path:string,line:bigint>>>>"
MOST_CLAIMS = 8


def _refuse(constant: str) -> None:
    raise ValueError(constant)


#: Halves of surrogate pairs, which no encoder takes, and the escapes that may make them.
_LONE = re.compile("[\ud800-\udfff]")
_ESCAPED = re.compile(r"\\u[dD][89a-fA-F]")


def _loaded(text: str) -> object:
    """The JSON value in text, lone surrogates replaced; ValueError for what is none, or nested too deep to be one of ours."""
    try:
        if _ESCAPED.search(text):
            text = json.dumps(json.loads(text, parse_constant=_refuse), ensure_ascii=False)
        return json.loads(_LONE.sub("\ufffd", text), parse_constant=_refuse)
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep


def first_object(text: str | None) -> dict | None:
    """The reply as a JSON object, without a code fence; else its first balanced {...}; null for anything else, lists included.

    Whatever the reply is, it raises nothing: it is a model's text.
    """
    rest = (text or "").strip()
    if rest.startswith("```"):
        rest = re.sub(r"```\s*$", "", re.sub(r"(?i)^```(?:json)?\s*", "", rest))
    depth, quoted, skip, start = 0, False, False, rest.find("{")
    for candidate in (rest, None):
        if candidate is None:
            for at in range(max(start, 0), len(rest)) if start >= 0 else ():
                c = rest[at]
                if skip or c == "\\":
                    skip = not skip
                    continue
                quoted ^= c == '"'
                depth += (not quoted) * ((c == "{") - (c == "}"))
                if c == "}" and not quoted and depth == 0:
                    candidate = rest[start : at + 1]
                    break
        try:
            found = _loaded(candidate) if candidate is not None else None
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) < 2**53


def claims_in(value: object, path: str | None, most: int) -> list[dict]:
    """Claims of a parsed list: those with text, citations by `lines` (of path) and `refs`, each place once; the first 2 * most entries are read."""
    out = []
    for entry in value[: 2 * most] if isinstance(value, list) else ():
        text = entry.get("text") if isinstance(entry, dict) else None
        if not isinstance(text, str) or not text.strip():
            continue
        lines, refs = entry.get("lines"), entry.get("refs")
        places = [(path, int(x)) for x in (lines if isinstance(lines, list) and path else ()) if _number(x)]
        places += [(r["path"], int(r["line"])) for r in (refs if isinstance(refs, list) else ()) if isinstance(r, dict) and isinstance(r.get("path"), str) and _number(r.get("line"))]
        out.append({"text": text.strip(), "citations": [{"path": p, "line": n} for p, n in dict.fromkeys(places)]})
    return out


def read_object(reply: Column) -> Column:
    """A reply's JSON object as text; null where it holds none."""

    @F.pandas_udf("string")
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(lambda x: None if (found := first_object(x)) is None else json.dumps(found, ensure_ascii=False))

    return run(reply)


def read_claims(reply: Column, key: str, path: Column | None = None, most: int = MOST_CLAIMS) -> Column:
    """The claims under `key` of a reply's object, CLAIMS; path is the file that plain line numbers are of."""

    @F.pandas_udf(CLAIMS)
    def run(replies: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([claims_in((first_object(r) or {}).get(key), p, most) for r, p in zip(replies, paths)])

    return run(reply, F.lit(None).cast("string") if path is None else path)


def grounded(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims(claim, path, line), files(path, loc) -> (claim, cited, kept): citations of each claim and those with 1 <= line <= max(loc, 1), each place once."""
    places = claims.select("claim", "path", "line").distinct()
    both = places.join(files.select("path", "loc"), "path", "left")
    ok = F.coalesce((F.col("line") >= 1) & (F.col("line") <= F.greatest("loc", F.lit(1))), F.lit(False))
    return both.groupBy("claim").agg(F.count("*").alias("cited"), F.count(F.when(ok, 1)).alias("kept"))


def keep_grounded(rows: DataFrame, files: DataFrame, id_column: str, claims: str = "claims", most: int = MOST_CLAIMS) -> DataFrame:
    """(id, claims): each row's claims with the citations that files(path, loc) bear out, in order; claims without any go, `most` stay.

    Rows that keep none have an empty list. Citations meet files by an equi-join on the path.
    """
    places = rows.select(id_column, F.posexplode(claims).alias("k", "c")).select(id_column, "k", "c.text", F.posexplode("c.citations").alias("j", "at"))
    facts = files.select(F.col("path").alias("known"), "loc")
    kept = places.join(facts, (F.col("at.path") == F.col("known")) & F.col("at.line").between(1, F.greatest("loc", F.lit(1))))
    one = kept.groupBy(id_column, "k").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("j", "at"))).alias("ats"))
    one = one.withColumn("citations", F.transform("ats", lambda x: x["at"]))
    whole = one.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("k", "text", "citations"))).alias("x"))
    found = F.slice(F.transform("x", lambda c: F.struct(c["text"].alias("text"), c["citations"].alias("citations"))), 1, most)
    return rows.select(id_column).join(whole.select(id_column, found.alias("found")), id_column, "left").select(id_column, F.coalesce("found", F.array().cast(CLAIMS)).alias(claims))


def distinct_citations(places: DataFrame, *key: str) -> DataFrame:
    """places(key..., path, line) -> (key..., citations): each place once, in order of path and line."""
    return places.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("path", "line"))).alias("citations"))


def points_of(summaries: DataFrame) -> DataFrame:
    """summaries(..., points CLAIMS) -> a row per point: its text and the line of its first citation; points without one have a null line."""
    rest = [c for c in summaries.columns if c != "points"]
    rows = summaries.select(*rest, F.explode("points").alias("p"))
    return rows.select(*rest, F.col("p.text").alias("text"), F.get(F.col("p.citations"), 0)["line"].alias("line"))
