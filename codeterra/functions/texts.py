"""Column functions on file contents and written claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest evidence headline.
HEADLINE = 160


def line_count(text: Column) -> Column:
    """Newlines and one; 0 for empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def utf8(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\0") > 0


def headline(text: Column, fallback: Column) -> Column:
    """White space collapsed, at most HEADLINE characters with an ellipsis as the last; fallback where nothing is left."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.when(F.length(flat) > HEADLINE, F.concat(F.substring(flat, 1, HEADLINE - 1), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(flat, F.lit("")) == "", fallback).otherwise(cut)


def number_lines(text: Column, most: int = 600, characters: int = 24_000) -> Column:
    """The first `most` lines, each after its number and a tab, cut at so many characters; notes say what was cut."""
    lines = F.split(text, "\n", -1)
    shown = F.array_join(F.transform(F.slice(lines, 1, most), lambda line, k: F.concat((k + 1).cast("string"), F.lit("\t"), line)), "\n")
    shown = F.when(F.length(shown) > characters, F.concat(F.substring(shown, 1, characters), F.lit("\n… (cut, too long)"))).otherwise(shown)
    note = F.concat(F.lit("\n… ("), F.size(lines).cast("string"), F.lit(f" lines, the first {most} are shown)"))
    return F.concat(shown, F.when(F.size(lines) > most, note).otherwise(""))


def same_word(a: Column, b: Column) -> Column:
    """Equality in any case."""
    return F.lower(a) == F.lower(b)


def unquote(text: Column) -> Column:
    """Without one quote at either end."""
    return F.regexp_replace(text, "^['\"`]|['\"`]\\z", "")


def file_slug(prefix: str, owner: Column, name: Column, sha: Column) -> Column:
    """A file name of safe characters."""
    return F.regexp_replace(F.concat_ws("-", F.lit(prefix), owner, name, F.coalesce(F.substring(sha, 1, 7), F.lit("latest"))), "[^a-zA-Z0-9._-]", "-")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words (letters and digits), each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    parts = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets; 0 where there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
