"""Imports and symbols of source files by line patterns, as column expressions; one row per line, no Python.

A line, without its comment, gives the import of the first rule that fits and the symbol of the first that fits. Go's
imports stand in blocks, so its lines carry whether the last block mark before them opened one; outside of blocks and
import lines, Go lines give symbols only, of every rule that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeterra.functions.regexes import portable

ENGINE = "pattern"
MOST_SYMBOLS = 300

# Import rules by language, in order, as (kind, pattern with the specifier as its group).
_SCRIPT_IMPORTS = (
    ("from", r"""^\s*import\s+[^'"]*from\s+['"]([^'"]+)['"]"""),
    ("import", r"""^\s*import\s+['"]([^'"]+)['"]"""),
    ("require", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("from", r"""^\s*export\s+[^'"]*from\s+['"]([^'"]+)['"]"""),
    ("import", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""),
)
_INCLUDES = (("include", r"""^\s*#include\s+[<"]([^>"]+)[>"]"""),)
_DOTTED = (("import", r"""^\s*import\s+([\w.]+)"""),)
IMPORT_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": _SCRIPT_IMPORTS,
    "typescript": _SCRIPT_IMPORTS,
    "tsx": _SCRIPT_IMPORTS,
    "vue": _SCRIPT_IMPORTS,
    "svelte": _SCRIPT_IMPORTS,
    "python": (("from", r"""^\s*from\s+([\w.]+)\s+import\b"""), ("import", r"""^\s*import\s+([\w.]+)""")),
    "go": (("import", r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)\""""),),
    "rust": (("use", r"""^\s*(?:pub\s+)?use\s+([\w:]+)"""),),
    "java": (("import", r"""^\s*import\s+(?:static\s+)?([\w.]+)"""),),
    "kotlin": _DOTTED,
    "swift": _DOTTED,
    "scala": _DOTTED,
    "ruby": (("require", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""),),
    "php": (("use", r"""^\s*use\s+([\w\\]+)"""), ("include", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""")),
    "c": _INCLUDES,
    "cpp": _INCLUDES,
    "csharp": (("use", r"""^\s*using\s+(?:static\s+)?([\w.]+)\s*;"""),),
    "elixir": (("use", r"""^\s*(?:import|alias|use)\s+([\w.]+)"""),),
    "lua": (("require", r"""\brequire\s*\(?\s*['"]([^'"]+)['"]"""),),
    "dart": (("import", r"""^\s*import\s+['"]([^'"]+)['"]"""),),
    "bash": (("include", r"""^\s*(?:\.|source)\s+([^\s;]+)"""),),
}
# Symbol rules by language, in order, as (kind, pattern with the name as its group).
_SCRIPT_SYMBOLS = (
    ("function", r"""^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"""),
    ("class", r"""^\s*(?:export\s+)?class\s+(\w+)"""),
    ("function", r"""^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"""),
)
_TYPED_SYMBOLS = (
    *_SCRIPT_SYMBOLS,
    ("interface", r"""^\s*(?:export\s+)?interface\s+(\w+)"""),
    ("type", r"""^\s*(?:export\s+)?type\s+(\w+)\s*="""),
)
SYMBOL_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": _SCRIPT_SYMBOLS,
    "typescript": _TYPED_SYMBOLS,
    "tsx": _TYPED_SYMBOLS,
    "vue": _TYPED_SYMBOLS,
    "svelte": _TYPED_SYMBOLS,
    "python": (("function", r"""^\s*(?:async\s+)?def\s+(\w+)"""), ("class", r"""^\s*class\s+(\w+)""")),
    "go": (("function", r"""^\s*func\s+(?:\([^)]*\)\s*)?(\w+)"""), ("type", r"""^\s*type\s+(\w+)\s+(?:struct|interface)\b""")),
    "rust": (("function", r"""^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"""), ("type", r"""^\s*(?:pub\s+)?struct\s+(\w+)""")),
    "java": (
        ("class", r"""^\s*(?:public|private|protected)?\s*class\s+(\w+)"""),
        ("method", r"""^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>[\]]+\s+(\w+)\s*\("""),
    ),
    "kotlin": (("function", r"""^\s*(?:public|private|internal)?\s*fun\s+(\w+)"""), ("class", r"""^\s*(?:data\s+)?class\s+(\w+)""")),
    "swift": (("function", r"""^\s*(?:public|private|internal)?\s*func\s+(\w+)"""), ("class", r"""^\s*(?:public\s+)?(?:final\s+)?class\s+(\w+)""")),
    "ruby": (("function", r"""^\s*def\s+([\w.?!]+)"""), ("class", r"""^\s*class\s+(\w+)""")),
    "php": (("function", r"""^\s*(?:public|private|protected)?\s*function\s+(\w+)"""), ("class", r"""^\s*class\s+(\w+)""")),
    "csharp": (("class", r"""^\s*(?:public|private|protected|internal)\s+(?:partial\s+)?class\s+(\w+)"""),),
    "bash": (("function", r"""^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"""),),
}
# Comment marks, and Go's block marks.
HASH_COMMENTS = ("python", "ruby", "bash")
COMMENT = {True: r"#.*$", False: r"//.*$"}
GO_OPENS, GO_CLOSES, GO_IMPORTS = r"^\s*import\s*\(", r"^\s*\)", r"^\s*import\s"


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """files(path, language, text) -> (path, language, line, text), a row per line, lines counted from 1."""
    rows = files.select("path", "language", F.posexplode(F.split(text, "\n", -1)).alias("k", "text"))
    return rows.select("path", "language", (F.col("k") + 1).cast("long").alias("line"), "text")


def without_comment(text: Column, language: Column) -> Column:
    """The line up to the language's comment mark, wherever that stands."""
    return F.when(language.isin(*HASH_COMMENTS), F.regexp_replace(text, portable(COMMENT[True]), "")).otherwise(F.regexp_replace(text, portable(COMMENT[False]), ""))


def in_block(lines: DataFrame) -> DataFrame:
    """Go lines(path, line, code) with inside (a block is open before this line) and mark (the line opens or closes one)."""
    opens, closes = F.col("code").rlike(portable(GO_OPENS)), F.col("code").rlike(portable(GO_CLOSES))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(opens, True).when(closes, False)
    inside = F.coalesce(F.last(change, ignorenulls=True).over(before), F.lit(False))
    return lines.withColumn("inside", inside).withColumn("mark", opens | (closes & F.col("inside")))


def _first(text: Column, rules: tuple[tuple[str, str], ...], name: str) -> Column:
    """struct(kind, name) of the first rule whose group is not empty, or null."""
    found = F.lit(None).cast(f"struct<kind:string,{name}:string>")
    for kind, pattern in reversed(rules):
        hit = F.regexp_extract(text, portable(pattern), 1)
        found = F.when(hit != "", F.struct(F.lit(kind).alias("kind"), hit.alias(name))).otherwise(found)
    return found


def _by_language(language: Column, table: dict[str, tuple[tuple[str, str], ...]], make) -> Column:
    """make(rules) for the rules of the row's language; languages with the same rules share one branch."""
    groups: dict[tuple, list[str]] = {}
    for name, rules in table.items():
        groups.setdefault(rules, []).append(name)
    out = None
    for rules, names in groups.items():
        out = F.when(language.isin(*names), make(rules)) if out is None else out.when(language.isin(*names), make(rules))
    return out


def _prepared(lines: DataFrame) -> DataFrame:
    """lines with code (no comment), plain (import rules apply) and mark (nothing applies)."""
    known = sorted({*IMPORT_RULES, *SYMBOL_RULES})
    coded = lines.where(F.col("language").isin(*known)).withColumn("code", without_comment(F.col("text"), F.col("language")))
    go = in_block(coded.where("language = 'go'"))
    go = go.withColumn("plain", F.col("inside") | F.col("code").rlike(portable(GO_IMPORTS))).drop("inside")
    rest = coded.where("language <> 'go'").withColumn("mark", F.lit(False)).withColumn("plain", F.lit(True))
    return go.unionByName(rest).where(~F.col("mark"))


def imports(lines: DataFrame) -> DataFrame:
    """lines(path, language, line, text) -> (path, language, line, specifier, kind) of every line with an import."""
    found = _by_language(F.col("language"), IMPORT_RULES, lambda rules: _first(F.col("code"), rules, "specifier"))
    # a generator, so that what follows does not repeat the rules
    rows = _prepared(lines).where("plain").select("path", "language", "line", F.explode(F.array_compact(F.array(found))).alias("x"))
    return rows.select("path", "language", "line", "x.specifier", "x.kind")


def symbols(lines: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """lines(path, language, line, text) -> (path, line, name, kind): the first `most` symbols of each file, in order."""
    code = F.col("code")
    one = _by_language(F.col("language"), SYMBOL_RULES, lambda rules: F.array(_first(code, rules, "name")))
    every = F.array(*[_first(code, (rule,), "name") for rule in SYMBOL_RULES["go"]])
    names = F.array_compact(F.when(F.col("plain"), one).otherwise(every))
    rows = _prepared(lines).select("path", "line", F.posexplode(names).alias("k", "x"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line", "k"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("path", "line", "x.name", "x.kind")


def engine_of(language: Column, parsed: Column) -> Column:
    """What reads a file: the pattern rules for every analysable language, nothing for others."""
    return F.when(parsed & language.isNotNull(), F.lit(ENGINE))
