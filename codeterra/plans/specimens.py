"""Queries on token-level structure: source files made of the part table, with what each of them holds stated beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeterra.operators import syntax
from codeterra.plans import tables as t
from codeterra.plans.sources import quoted
from codeterra.plans.structure import query

#: Language, engine, text and what is in it, as (what, line, name, kind); {k} is the file's number. Up to two lines of comment stand before a text.
SPECIMENS = (
    (
        "typescript",
        "syntax",
        "import {\n  a,\n  type B, // import x from './no'\n} from './many{k}'\nconst u = 'https://x/' + require('kept{k}') // require('no')\n/* import './no'\n*/ export * from \"./all\"\nexport class Main{k}<T extends { a: string }> extends Base<T> {\n  private readonly make = () => 1\n  static async *run<T>(x: T = { a: 1 }): AsyncGenerator<T> { if (x) { call() } }\n  get size(): number { return `a ${ size() + `b ${1}` }` }\n  abstract gone(): void\n}\nexport const over = (x: (y: string) => void): number => 1, two = async z => z\ninterface I{k} { m(): void }\ntype T{k}<A> = A | import('./typed')\nfunction early(a: string): void\nasync function late{k}() { const re = /['\"{`]/ }\n",
        (
            ("import", 1, "./many{k}", "from"),
            ("import", 5, "kept{k}", "require"),
            ("import", 7, "./all", "from"),
            ("import", 16, "./typed", "import"),
            ("symbol", 8, "Main{k}", "class"),
            ("symbol", 10, "run", "method"),
            ("symbol", 11, "size", "method"),
            ("symbol", 14, "over", "function"),
            ("symbol", 14, "two", "function"),
            ("symbol", 15, "I{k}", "interface"),
            ("symbol", 16, "T{k}", "type"),
            ("symbol", 18, "late{k}", "function"),
        ),
    ),
    (
        "python",
        "syntax",
        'from ..pkg{k} import (\n    one,\n    two,\n)\nimport os.path as p, sys\ntext = """\nimport no\ndef no(): pass\n"""\n@wraps(x)\nasync def run{k}(a):\n    class Inner: # def no(): pass\n        def method(self): from . import late\n',
        (("import", 1, "..pkg{k}", "from"), ("import", 5, "os.path", "import"), ("import", 13, ".", "from"), ("symbol", 11, "run{k}", "function"), ("symbol", 12, "Inner", "class"), ("symbol", 13, "method", "function")),
    ),
    (
        "go",
        "syntax",
        'package m\nimport (\n\t"fmt"\n\t// "no"\n\tx "ex.org/r/m{k}"\n)\nimport . "dot"\nvar raw = `\nimport "no"\nfunc No() {}\n`\ntype (\n\tOne{k} struct{ f func(x int) }\n\tAlias = int\n)\nfunc (t *T) Run{k}() {}\nfunc Plain[T any](x []T) {}\n',
        (("import", 3, "fmt", "import"), ("import", 5, "ex.org/r/m{k}", "import"), ("import", 7, "dot", "import"), ("symbol", 13, "One{k}", "type"), ("symbol", 16, "Run{k}", "method"), ("symbol", 17, "Plain", "function")),
    ),
    (
        "rust",
        "syntax",
        'use std::{io, fmt};\npub(crate) use a::b{k} as c;\n/* one /* two */ use no; */\nconst S: &str = r#"fn no() {} " "#;\npub async fn run{k}<\'a>(x: &\'a str) -> char { \'a\' }\ntrait Q { fn sig(&self); fn with(&self) {} }\npub struct P{k}(fn(u8) -> u8);\nenum E { A }\n',
        (("import", 1, "std::{io, fmt}", "use"), ("import", 2, "a::b{k} as c", "use"), ("symbol", 5, "run{k}", "function"), ("symbol", 6, "with", "function"), ("symbol", 7, "P{k}", "type"), ("symbol", 8, "E", "type")),
    ),
    # brackets that don't pair, another version's grammar, and a language without tokens are left to the line patterns
    ("javascript", "pattern", "import x from './x{k}'\nimport {\n  y } from './lost'\nfunction open{k}() {\n", (("import", 1, "./x{k}", "from"), ("symbol", 4, "open{k}", "function"))),
    ("python", "pattern", "import old{k}\nprint 'x'\ndef f(): pass\n", (("import", 1, "old{k}", "import"), ("symbol", 3, "f", "function"))),
    ("ruby", "pattern", "require 'json{k}'\nclass A\n", (("import", 1, "json{k}", "require"), ("symbol", 2, "A", "class"))),
)
_COMMENTS = {"python": "# import no\n", "ruby": "# require 'no'\n"}
_LATER = 3


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text), a file for each part."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(SPECIMENS) + 1).cast("int"))
    before = F.repeat(pick([_COMMENTS.get(s[0], "// import './no'\n") for s in SPECIMENS]), (k % _LATER).cast("int"))
    text = F.concat(before, F.replace(pick([s[2] for s in SPECIMENS]), F.lit("{k}"), k.cast("string")))
    part = t.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    return part.select(F.concat(F.lit("f"), k.cast("string")).alias("path"), pick([s[0] for s in SPECIMENS]).alias("language"), text.alias("text"))


_ROWS = ", ".join(f"({i}, {quoted(s[0])}, {quoted(what)}, {line}, {quoted(name)}, {quoted(kind)})" for i, s in enumerate(SPECIMENS) for what, line, name, kind in s[3])
_HELD = f"""held AS (
  SELECT 'f' || p_partkey AS path, language, what, CAST(line + p_partkey % {_LATER} AS BIGINT) AS line, replace(name, '{{k}}', CAST(p_partkey AS VARCHAR)) AS name, kind
  FROM part JOIN (VALUES {_ROWS}) v(i, language, what, line, name, kind) ON p_partkey % {len(SPECIMENS)} = i)"""


@query(f"WITH {_HELD} SELECT path, language, line, name AS specifier, kind FROM held WHERE what = 'import'")
def syntax_imports(s, d):
    return syntax.imports(t.settled(syntax.read(specimens(s, d))))


@query(f"WITH {_HELD} SELECT path, line, name, kind FROM held WHERE what = 'symbol'")
def syntax_symbols(s, d):
    return syntax.symbols(t.settled(syntax.read(specimens(s, d))))


_ENGINES = ", ".join(f"({i}, {quoted(s[1])})" for i, s in enumerate(SPECIMENS))


@query(f"SELECT engine, count(*) AS files FROM part JOIN (VALUES {_ENGINES}) v(i, engine) ON p_partkey % {len(SPECIMENS)} = i GROUP BY engine")
def syntax_engines(s, d):
    return syntax.engines(syntax.read(specimens(s, d))).groupBy("engine").agg(F.count("*").alias("files"))
