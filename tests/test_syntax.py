"""Imports and symbols by tokens: what statements hold wherever their lines end, and what only looks like one."""

import pytest

from codeterra.operators import syntax
from tests.conftest import frame

SCRIPT = """import { read } from 'node:fs/promises';
import first from './first';
export { thing } from '../shared/thing';
const lazy = await import('./lazy');
const old = require('./old');
import {
  a,
  type B, // import x from './ghost'
} from './many'
const u = 'https://x/' + require('kept') /* require('no') */
const t = `a ${require('in' ) + `n ${1}`} // no comment`
import './side'
import json from './data.json' assert { type: 'json' }
import eq = require('eq')
export * as ns from './ns'
export type { Q } from "./q"
foo.require('no'); x = { require: 1, class: 2, function: 3, type: 4 }
const dyn = import(`./l/${name}.js`), two = require('a' + b)
const from = 1
import from from './from'
type A<T> = T extends import('./typed') ? 1 : 2
"""
IMPORTS = [
    (1, "node:fs/promises", "from"),
    (2, "./first", "from"),
    (3, "../shared/thing", "from"),
    (4, "./lazy", "import"),
    (5, "./old", "require"),
    (6, "./many", "from"),
    (10, "kept", "require"),
    (11, "in", "require"),
    (12, "./side", "from"),
    (13, "./data.json", "from"),
    (15, "./ns", "from"),
    (16, "./q", "from"),
    (18, "./l/${name}.js", "import"),
    (20, "./from", "from"),
    (21, "./typed", "import"),
]
DECLARED = """export interface Options { deep: boolean; run(): void }
export type Handler = (input: string) => void;
export async function analyze(path: string) {
  return read(path);
}
export const format = (value: string) => value.trim();
@Injectable({ a: 1 })
class Big<T extends { a: string }> extends mixin({ b() { return 1 } })<T> implements I {
  private readonly x: Map<string, () => void> = new Map()
  static async *gen<T>(a: T = { a: 1 }): AsyncGenerator<T> {
    if (a) { foo() }
  }
  get value(): { a: string } { return this.y }
  #secret() {}
  [Symbol.iterator]() {}
  'quoted name'() {}
  abstract other(): void
  handler = () => { while (1) {} }
  constructor(private a: string, public b = (x) => x) { super() }
}
const f: (a: string) => void = (a) => {}, g = async x => x, h = function () {}, i = function* () {}
let re = /['"`{]/.test(x) ? 1 : 2, z = 5 / 2 / 1
export function over(a: string): string
export function over(a: any): any { return a }
declare function ext(): void
abstract class Abs { foo() {} }
const o = { m() { return 1 }, async n() {}, get p() { return 1 }, q: function () {}, r: () => {} }
const el = <div className="a">Don't {x} // no</div>
function* last() { type.x = 1 }
"""
SYMBOLS = [
    (1, "Options", "interface"),
    (2, "Handler", "type"),
    (3, "analyze", "function"),
    (6, "format", "function"),
    (7, "Big", "class"),
    (8, "b", "method"),
    (10, "gen", "method"),
    (13, "value", "method"),
    (14, "#secret", "method"),
    (15, "[Symbol.iterator]", "method"),
    (16, "'quoted name'", "method"),
    (19, "constructor", "method"),
    (21, "f", "function"),
    (21, "g", "function"),
    (21, "h", "function"),
    (24, "over", "function"),
    (26, "foo", "method"),
    (27, "m", "method"),
    (27, "n", "method"),
    (27, "p", "method"),
    (29, "last", "function"),
]


def found(source, language, what):
    return [x[1:] for x in syntax.structure_of(source, language) if x[0] == what]


@pytest.mark.parametrize("language", ["typescript", "tsx"])
def test_scripts(language):
    assert found(SCRIPT, language, "import") == IMPORTS
    assert found(DECLARED, language, "symbol") == SYMBOLS


def test_go():
    source = 'package main\n\nimport (\n\t"fmt"\n\t// "no"\n\tst "example.com/app/internal/store"\n)\nimport . "dot"\n\ntype Reporter struct{ a func(x int) }\ntype Alias = int\ntype (\n\tOne int\n\tTwo interface {\n\t\tFoo()\n\t}\n)\nvar r = `\nimport "raw"\nfunc Raw() {}\n`\nvar f = func(a int) string { return "" }\nfunc (r Reporter) Render() string {\n\ttype inner struct{}\n\treturn fmt.Sprint(store.Name)\n}\nfunc Map[T any](x []T) {}\nfunc Analyze(path string) string { return path }\n'
    assert found(source, "go", "import") == [(4, "fmt", "import"), (6, "example.com/app/internal/store", "import"), (8, "dot", "import")]
    assert found(source, "go", "symbol") == [(10, "Reporter", "type"), (13, "One", "type"), (14, "Two", "type"), (23, "Render", "method"), (24, "inner", "type"), (27, "Map", "function"), (28, "Analyze", "function")]


def test_rust():
    source = 'use std::{\n    io,\n};\npub(crate) use a::b as c;\n/* one /* two */ use no; */\nconst S: &str = r#"fn no() {} "quoted" "#;\npub async fn run<\'a>(x: &\'a str, c: char) -> Result<(), E> where T: X { let y = \'a\'; fn inner() {} }\ntrait T { fn sig(&self); fn with(&self) { } }\npub struct P { a: fn(u8) -> u8 }\npub unsafe extern "C" fn ffi() {}\nenum E { A }\nimpl P { pub fn new() -> Self { use inner::x; P {} } }\nlet s = "multi\nline { ";\n'
    assert found(source, "rust", "import") == [(1, "std::{\n    io,\n}", "use"), (4, "a::b as c", "use"), (12, "inner::x", "use")]
    assert found(source, "rust", "symbol") == [(7, "run", "function"), (7, "inner", "function"), (8, "with", "function"), (9, "P", "type"), (10, "ffi", "function"), (11, "E", "type"), (12, "new", "function")]


def test_python():
    source = "from __future__ import a\nimport os, sys\nimport a.b as c\nfrom . import (\n  x,\n)\nfrom ..p.q import z\n@d\ndef f():\n    class G: pass\n    async def h(): import late\ns='''\nimport no\n'''"
    assert found(source, "python", "import") == [(2, "os", "import"), (3, "a.b", "import"), (4, ".", "from"), (7, "..p.q", "from"), (11, "late", "import")]
    assert found(source, "python", "symbol") == [(9, "f", "function"), (10, "G", "class"), (11, "h", "function")]


def test_what_is_left_to_patterns():
    assert all(syntax.structure_of(x, "typescript") is None for x in ("a = {", "f(]", "}", "/* no end", "`no end", "`${1", "`${1`}"))
    assert syntax.structure_of("print 1", "python") is None and syntax.structure_of("a\x00", "python") is None and syntax.structure_of("(" * 5000, "python") is None
    assert syntax.structure_of("fn a() {", "rust") is None and syntax.structure_of("", "go") == []


def test_either_engine(spark):
    rows = [("a.ts", "typescript", "import {\n a\n} from './a'\n"), ("b.ts", "typescript", "import b from './b'\nfunction f() {\n"), ("c.rb", "ruby", "require 'json'\ndef r\nend\n"), ("d.txt", None, "import x"), ("e.py", "python", ""), ("f.sql", "sql", "select 1"), ("g.go", "go", None)]
    read = syntax.read(frame(spark, [(*r, 1) for r in rows], "path string, language string, text string, found int"))
    assert sorted(map(tuple, syntax.imports(read).collect())) == [("a.ts", "typescript", 1, "./a", "from"), ("b.ts", "typescript", 1, "./b", "from"), ("c.rb", "ruby", 1, "json", "require")]
    assert sorted(map(tuple, syntax.symbols(read).collect())) == [("b.ts", 2, "f", "function"), ("c.rb", 2, "r", "function")]
    assert {r["path"]: r["engine"] for r in syntax.engines(read).collect()} == {"a.ts": "syntax", "b.ts": "pattern", "c.rb": "pattern", "e.py": "syntax", "f.sql": "pattern", "g.go": "pattern"}
    many = frame(spark, [("m.py", "python", "\n".join(f"def f{k}(): pass" for k in range(400)))], "path string, language string, text string")
    assert sorted(r["line"] for r in syntax.symbols(syntax.read(many)).collect()) == list(range(1, 301))
