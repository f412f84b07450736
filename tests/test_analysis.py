"""The whole analysis of a small repository, again after a change, and what is stored of it."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeterra import store
from codeterra.functions import texts
from codeterra.operators import analysis, comprehension, grounding, notes, parsing, reading, report, views
from codeterra.sources import git
from tests.conftest import frame

FILES = {
    "src/main.ts": "import { low } from './low'\nimport { mid } from './lib/mid'\nimport fs from 'fs'\nimport './gone'\nexport const start = () => low()\n",
    "src/low.ts": "export function low() {\n  return 1\n}\n",
    "src/lib/mid.ts": "import { low } from '../low'\nexport class Mid {}\n",
    "src/alone.ts": "const apiKey = 'abcdefghijklmnopqrst'\n",
    "tools/one.py": "from .two import x\nimport os\ndef run():\n    pass\n",
    "tools/two.py": "from .one import run\nx = 1\n",
    "go.mod": "module ex.org/r\n",
    "cmd/a.go": 'package a\nimport "ex.org/r/pkg"\nfunc A() {}\n',
    "pkg/b.go": "package pkg\n",
    "README.md": "# hi\n",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for args in (("init", "-q"), ("add", "."), ("commit", "-qm", "one")):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=ann", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    return root


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_analysis_again_and_its_store(spark, repository, tmp_path):
    got = analysis.analyze_folder(spark, str(repository))
    edges = [("cmd/a.go", "pkg/b.go", 0.9), ("src/lib/mid.ts", "src/low.ts", 0.9), ("src/main.ts", "src/lib/mid.ts", 0.9), ("src/main.ts", "src/low.ts", 0.9), ("tools/one.py", "tools/two.py", 0.9), ("tools/two.py", "tools/one.py", 0.9)]
    assert rows(got.edges, "src", "dst", "confidence") == edges
    assert tuple(got.totals.first())[:2] == (10, 8) and got.unresolved.first()[0] == 1
    assert rows(got.file_externals, "path", "specifier", "count") == [("src/main.ts", "fs", 1), ("tools/one.py", "os", 1)]
    assert rows(got.symbols, "path", "line", "name", "kind") == [("cmd/a.go", 3, "A", "function"), ("src/lib/mid.ts", 2, "Mid", "class"), ("src/low.ts", 1, "low", "function"), ("src/main.ts", 5, "start", "function"), ("tools/one.py", 3, "run", "function")]
    assert [tuple(r["nodes"]) for r in got.cycles.collect()] == [("tools/one.py", "tools/two.py")]
    assert rows(got.dead, "path") == [("cmd/a.go",), ("src/alone.ts",)] and rows(got.findings, "path", "rule") == [("src/alone.ts", "hardcoded-secret")]
    facts = {r["path"]: (r["dependents"], r["blast"], r["churn"], r["engine"], [a["name"] for a in r["authors"]]) for r in got.files.collect()}
    assert facts["src/low.ts"] == (2, 2, 1, "syntax", ["ann"]) and facts["README.md"] == (0, 0, 1, None, ["ann"]) and facts["tools/one.py"][:2] == (1, 1)
    # dead 2 of 8: 25, cycles 2 of 8: 37.5, at most 25, security 8
    assert tuple(got.health.select("dead_penalty", "cycle_penalty", "coupling_penalty", "security_penalty", "score", "grade").first()) == (25, 25, 0, 8, 42, "F")
    assert got.warnings.count() == 0 and rows(got.engines, "engine", "files") == [("syntax", 8)]

    kept = store.Store(spark, f"file://{tmp_path}/store")
    assert kept.read("files") is None
    header = spark.range(1).select(F.lit("github.com").alias("host"), F.lit("o").alias("owner"), F.lit("n").alias("name"), F.lit("done").alias("status"), F.lit(1).alias("created_at"))
    for name in ("one", "two"):
        kept.replace_analysis(name, got.tables(), header)
    kept.replace_analysis("one", {"edges": got.edges.limit(2), "findings": got.findings.limit(0)}, header)
    assert kept.of("edges", "one").count() == 2 and kept.of("edges", "two").count() == 6 and kept.of("findings", "one").count() == 0 and kept.of("findings", "two").count() == 1
    assert store.cached(kept.read("analyses"), "GITHUB.com", "o", "n").first()["analysis_id"] == "two"
    assert store.cached(kept.read("analyses"), "github.com", "o", "n", 2).count() == 0

    (repository / "src/low.ts").unlink()
    (repository / "src/lib/mid.ts").write_text("import x from 'fs'\n")
    last = {name: kept.of(name, "two") for name in store.RESULT_TABLES}
    again = analysis.analyze_folder(spark, str(repository), analysis.Previous(**last))
    assert rows(again.edges, "src", "dst") == [("cmd/a.go", "pkg/b.go"), ("src/main.ts", "src/lib/mid.ts"), ("tools/one.py", "tools/two.py"), ("tools/two.py", "tools/one.py")]
    assert rows(again.external, "specifier", "count") == [("fs", 2), ("os", 1)] and again.reused.count() == 8
    assert rows(again.symbols, "name") == [("A",), ("run",), ("start",)] and again.findings.count() == 1 and rows(again.engines, "engine", "files") == [("syntax", 7)]


def test_clone(spark, repository, tmp_path):
    made = git.clone(f"file://{repository}", str(tmp_path))
    assert len(made.commit) == 40 and made.branch and git.history(spark, made.folder).count() == len(FILES)
    with pytest.raises(git.GitError) as said:
        git.clone(str(tmp_path / "none"), str(tmp_path))
    assert spark.range(1).select(git.failure_reason(F.lit(str(said.value)))).first()[0]


def test_jobs_and_keyed_rows(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    assert kept.upsert_repo("h", "o", "n", 1) == kept.upsert_repo("h", "o", "n", 2) and kept.current("repos").count() == 1
    kept.progress("j", 1, status="running", stage="files", percent=10, files_total=4)
    kept.progress("j", 2, status="running", percent=50, files_done=2)
    kept.progress("k", 1, status="running")
    kept.fail("k", 2, "no key")
    now = {r["job"]: (r["status"], r["stage"], r["percent"], r["coverage"], r["error"]) for r in kept.jobs().collect()}
    assert now == {"j": ("running", "files", 50, 0.5, None), "k": ("failed", None, None, 0.0, "no key")}
    seen = []
    kept.follow("j", lambda df: seen.extend(r["percent"] for r in df.select("percent").collect()), f"file://{tmp_path}/follow")
    assert seen[0] == 50 and sorted(seen[1:]) == [10, 50]
    for version in (1, 2):
        kept.upsert("summaries", frame(spark, [("r", "file", "a", f"v{version}")], "comprehension_id string, scope string, key string, headline string"), F.lit(version))
    kept.compact("summaries")
    assert [r["headline"] for r in kept.current("summaries").collect()] == ["v2"] and kept.read("summaries").count() == 1
    assert store.live(frame(spark, [(1,), (3,)], "expires_at int"), F.lit(2)).count() == 1


def test_parsing_traps(spark):
    source = {
        "a.ts": ("typescript", "const u = 'https://x' + require('cut')\nimport x from 'kept' // import 'no'\nrequire('a'); import('b')\nexport default 1\r\nimport 'crlf' // z\r"),
        "b.go": ("go", 'var s = "no"\nimport (\n"in"\n)\n"out"\nimport "single"\n'),
        "c.py": ("python", "from . import z\nimport a.b, c # import d\n    from x.y import (\n"),
        "d.txt": (None, "import x"),
        "e.sh": ("bash", ". ./x.sh;y\nfunction f() {\n"),
    }
    lines = parsing.lines_of(frame(spark, [(p, *v) for p, v in source.items()], "path string, language string, text string"))
    got = rows(parsing.imports(lines), "path", "line", "specifier", "kind")
    assert got == [("a.ts", 2, "kept", "from"), ("a.ts", 3, "a", "require"), ("a.ts", 5, "crlf", "import"), ("b.go", 3, "in", "import"), ("b.go", 6, "single", "import"), ("c.py", 1, ".", "from"), ("c.py", 2, "a.b", "import"), ("c.py", 3, "x.y", "from"), ("e.sh", 1, "./x.sh", "include")]
    many = frame(spark, [("m.py", "python", "\n".join(f"def f{k}(): pass" for k in range(400)))], "path string, language string, text string")
    assert parsing.symbols(parsing.lines_of(many)).agg(F.count("*"), F.max("line")).first() == (300, 300)


def test_replies(spark):
    cases = {'{"a": 1}': True, '```json\n{"a": "}"}\n```': True, 'so {"a": "\\"}{"} and {"b"': True, "[1]": False, "[{}]": True, '{"a": NaN}': False, "{broken": False, "": False, None: False, "3": False}
    got = {r["x"]: r["y"] is not None for r in frame(spark, [(x,) for x in cases], "x string").select("x", grounding.read_object(F.col("x")).alias("y")).collect()}
    assert got == cases
    odd = ['{"a": "\\ud800", "b": "\\ud83d\\ude00"}', "[" * 60_000, '{"a":' * 60_000, '{"a": [' + "[" * 60_000, "\ufffd{", '{"points":[{"text":"\\udc00 x"}]}', '{"a": 1e999}', '{"a": ' + "9" * 5000 + "}"]
    got = [(r["y"], r["z"]) for r in frame(spark, list(enumerate(odd)), "k int, x string").orderBy("k").select(grounding.read_object(F.col("x")).alias("y"), grounding.read_claims(F.col("x"), "points").alias("z")).collect()]
    assert got[0][0] == '{"a": "\ufffd", "b": "\U0001f600"}' and [y is None for y, _ in got] == [False, True, True, True, True, False, False, True] and got[5][1][0]["text"] == "\ufffd x"
    reply = '{"points":[{"text":" t ","lines":[2.9,2,true,"1",99]},{"text":"gone","lines":[50]},{"text":"r","refs":[{"path":"b","line":1},{"path":"b"}]}]}'
    made = frame(spark, [(1, reply), (2, None)], "id int, reply string").select("id", grounding.read_claims(F.col("reply"), "points", F.lit("a")).alias("claims"))
    kept = {r["id"]: [(c["text"], [tuple(x) for x in c["citations"]]) for c in r["claims"]] for r in grounding.keep_grounded(made, frame(spark, [("a", 5), ("b", 0)], "path string, loc int"), "id").collect()}
    assert kept == {1: [("t", [("a", 2)]), ("r", [("b", 1)])], 2: []}
    assert [views.clamp(n, 1, 5) for n in (-3, 2, 9)] == [1, 2, 5]


def test_reading_steps_by_size(spark):
    def chosen(n):
        facts = spark.range(n).select(F.col("id").alias("node"), (F.col("id") % 3).alias("level"), F.col("id").alias("dependents"), F.lit(0).alias("blast"), F.lit(0).alias("churn"), F.lit(False).alias("entry"))
        return [(r["node"], r["level"]) for r in reading.steps(facts).orderBy("step").collect()]

    assert len(chosen(0)) == 0 and len(chosen(5)) == 5 and len(chosen(40)) == 7 and len(chosen(120)) == 10 and len(chosen(400)) == 15
    assert chosen(40) == sorted(chosen(40), key=lambda x: (x[1], x[0])) and {n for n, _ in chosen(40)} == set(range(33, 40))
    facts = frame(spark, [(1, 3, 0, False), (2, 0, 4, True)], "node int, dependents int, dependencies int, entry boolean")
    said = frame(spark, [(1, "because")], "step int, t string").select("step", reading.cite(F.col("t"), F.lit("x"), F.lit(1)).alias("why"), F.array().cast(grounding.CLAIMS).alias("look_for"))
    path = reading.reading_path(frame(spark, [(1, 1), (2, 2)], "step int, node int"), facts, said).orderBy("step").collect()
    assert path[0]["why"][0]["text"] == "because" and "4 other files" in path[1]["why"][0]["text"]


def test_report_leaves_empty_sections_out(spark):
    repo = frame(spark, [("o", "n", "h", None, "abc")], "owner string, name string, host string, branch string, commit string")
    totals = frame(spark, [(3, 2, 10)], "files long, parsed long, loc long")
    score = frame(spark, [(75, "C", 17, 0, 0, 8)], "score int, grade string, dead_penalty int, cycle_penalty int, coupling_penalty int, security_penalty int")
    loops = frame(spark, [("a", 2, ["a", "b"])], "cycle string, size int, nodes array<string>")
    steps = frame(spark, [(1, "a")], "step int, node string").select("step", "node", reading.cite(F.lit("w"), F.lit("a"), F.lit(1)).alias("why"), F.array().cast(grounding.CLAIMS).alias("look_for"))
    claims = reading.cite(F.lit("p"), F.lit("a"), F.lit(2))
    digest = spark.range(1).select(F.lit("all").alias("headline"), *[claims.alias(c) for c in ("purpose", "stack", "entrypoints", "how_to_run", "notes")])
    text = report.markdown(report.summary(repo, totals, score), report.cycles(loops), report.dead(frame(spark, [], "path string")), report.digest(digest), report.modules(frame(spark, [], f"module string, headline string, points {grounding.CLAIMS}")), report.reading(steps)).first()["report"]
    assert text.startswith("# o/n\n\n- Host: h\n- Branch: unknown\n- Commit: abc\n") and "Grade **C** (75 / 100)" in text and "- `a` → `b`" in text and "### 1. `a`\n\n- w (`a:1`)" in text and "- p (`a:2`)" in text
    assert "nothing uses" not in text and "Security" not in text and text.index("## Overview") < text.index("## Health") < text.index("## Dependency cycles")


def test_notes_and_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\r\nversion: 1.10.0\r\ndate: d\r\ntitle: t: u\r\n---\r\n## Fixed\r\n- one\r\n  more\r\n")
    (tmp_path / "b.md").write_text("---\nversion: 1.9.0\ndate: d\ntitle:\n---\n## Fixed\n")
    got = {r["source"]: (r["version"], r["title"], [(s["heading"], s["items"]) for s in r["sections"]], r["error"]) for r in notes.parse(notes.read(spark, str(tmp_path))).collect()}
    assert got == {"a.md": ("1.10.0", "t: u", [("Fixed", ["one more"])], None), "b.md": ("1.9.0", "", [("Fixed", [])], "no title")}
    assert spark.range(1).select(notes.version_key(F.lit("1.10")), texts.number_lines(F.lit("a\nb\nc"), 2, 3)).first() == ([1, 10, 0], "1\ta\n… (cut, too long)\n… (3 lines, the first 2 are shown)")


def test_comprehension_falls_back_and_grounds(spark):
    files = frame(spark, [("src/main.ts", "typescript", 10, 2, 1, None), ("src/b.ts", "typescript", 10, 3, 0, None), ("x.bin", None, 5, 0, 0, "binary")], "path string, language string, bytes long, loc long, dependents int, skip_reason string")
    contents = frame(spark, [("src/main.ts", "a\nb"), ("src/b.ts", "c")], "path string, text string")
    symbols = frame(spark, [("src/b.ts", 2, "f", "function")], "path string, line long, name string, kind string")
    edges = frame(spark, [("src/b.ts", "src/main.ts")], "src string, dst string")

    def ask(prompt):
        if prompt.startswith("File: src/main.ts"):
            assert "Files that depend on it: src/b.ts" in prompt and "1\ta\n2\tb" in prompt
            return '{"headline":"starts","points":[{"text":"p","lines":[2,3]}]}'
        if prompt.startswith("Repository"):
            return '{"headline":"all","purpose":[{"text":"w","refs":[{"path":"src/b.ts","line":1}]}],"entrypoints":[{"text":"no","refs":[{"path":"gone","line":1}]}]}'
        raise RuntimeError("busy")

    got = comprehension.comprehend(files, contents, symbols, edges, "o/n", ask)
    told = {r["path"]: (r["headline"], [(c["text"], [tuple(x) for x in c["citations"]]) for c in r["points"]], r["source"]) for r in got.files.collect()}
    assert told["src/main.ts"] == ("starts", [("p", [("src/main.ts", 2)])], "model")
    assert told["src/b.ts"] == ("typescript file of 3 lines, 1 declared", [("function f", [("src/b.ts", 2)])], "analyzer") and told["x.bin"][2] == "analyzer"
    assert {(r["module"], r["files"], r["source"]) for r in got.modules.collect()} == {("src", 2, "analyzer"), (".", 1, "analyzer")}
    repo = got.repo.first()
    assert repo["headline"] == "all" and repo["purpose"][0]["text"] == "w" and "main.ts looks like" in repo["entrypoints"][0]["text"] and repo["notes"] == []
    assert {r["error"] for r in got.warnings.collect()} == {"busy"}

    def refuse(prompt):
        raise comprehension.FatalError("bad key")

    with pytest.raises(Exception, match="bad key"):
        comprehension.comprehend(files, contents, symbols, edges, "o/n", refuse).files.count()


def test_reading_order_among_readable_files(spark):
    files = frame(spark, [("a", "go", 3, 0, 0, 0, None), ("b", "go", 3, 2, 2, 0, None), ("c", "go", 0, 0, 0, 0, None), ("d", "go", 3, 0, 0, 0, "binary"), ("main.go", "go", 3, 0, 0, 4, None)], "path string, language string, loc int, dependents int, blast int, churn int, skip_reason string")
    edges = frame(spark, [("a", "b"), ("main.go", "a"), ("a", "c"), ("main.go", "b")], "src string, dst string")
    facts = reading.candidates(files, edges, analysis.is_entry(F.col("path")))
    assert rows(facts, "path", "dependencies", "entry") == [("a", 2, False), ("b", 0, False), ("main.go", 2, True)]
    assert [(r["step"], r["node"]) for r in reading.steps(reading.order(facts, edges)).orderBy("step").collect()] == [(1, "b"), (2, "a"), (3, "main.go")]


def test_max_files_counts_what_is_listed(spark, tmp_path):
    """Files that are left out anyway don't use up the limit, and the reader is told when it is reached."""
    for k in range(6):
        (tmp_path / f"a{k}.min.js").write_text("x")
    (tmp_path / "yarn.lock").write_text("x")
    for k in range(4):
        (tmp_path / f"z{k}.ts").write_text("export const a = 1\n")
    assert git.tree(spark, str(tmp_path), max_files=6).count() == 4
    few = git.tree(spark, str(tmp_path), max_files=3)
    assert rows(few, "path") == [("z0.ts",), ("z1.ts",), ("z2.ts",)]
    told = analysis.analyze(few, frame(spark, [], "path string, author string, sha string, ts timestamp, ordinal long"), max_files=3).warnings
    assert any("first files" in r["warning"] for r in told.collect())
