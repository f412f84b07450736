"""Column functions on source paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeterra.functions.regexes import portable


def normalize(path: Column) -> Column:
    """Drops empty and `.` segments; `..` takes the one before it away, or nothing at the root."""
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    """All before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_of(path: Column) -> Column:
    """The folder, or `.` at the root."""
    folder = directory_of(path)
    return F.when(folder == "", ".").otherwise(folder)


def extension_of(path: Column) -> Column:
    """From the last dot of the base name, in lower case; dotfiles have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


# Paths that count as entry points, and paths that are not production code.
ENTRY_POINTS = (
    r"(?i)(^|/)(index|main|app|server|worker|cli|setup|conftest)\.[\w.]+$",
    r"(^|/)__init__\.py$",
    r"(^|/)page\.[jt]sx?$",
    r"(^|/)layout\.[jt]sx?$",
    r"(^|/)route\.[jt]sx?$",
    r"(^|/)middleware\.[jt]sx?$",
    r"(?i)\.(test|spec)\.[\w.]+$",
    r"(?i)(^|/)(tests?|spec|__tests__|fixtures?|examples?|docs?|scripts?|migrations?)/",
    r"(?i)(^|/)[^/]*\.config\.[\w.]+$",
    r"(?i)(^|/)(README|CHANGELOG|LICENSE)",
)
NOT_PRODUCTION = r"(?i)(^|/)(tests?|spec|__tests__|__mocks__|fixtures?|examples?|samples?|docs?|e2e)/|\.(test|spec)\.[\w.]+$|\.md$"


def is_entry_point(path: Column) -> Column:
    found = F.lit(False)
    for pattern in ENTRY_POINTS:
        found = found | path.rlike(portable(pattern))
    return found


def is_production(path: Column) -> Column:
    return ~path.rlike(portable(NOT_PRODUCTION))


def contains_keyword(path: Column, keyword: str) -> Column:
    """The trimmed keyword somewhere in the path, in any case; a blank one is in all paths."""
    word = keyword.strip().lower()
    return F.lower(path).contains(word) if word else F.lit(True)


def top_folder(path: Column) -> Column:
    """The first segment, or `.` for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")
