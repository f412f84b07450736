"""How much work and room the operators take as their input grows."""

from codeterra.operators import resolve, trigrams
from codeterra.plans import sources, specimens, structure  # noqa: F401
from codeterra.sources import git
from tests.conftest import frame

SF = "/root/testdata/sf0.1"


def test_files_made_of_small_rows_are_dealt_to_tasks(spark):
    assert sources.sources(spark, SF).rdd.getNumPartitions() == specimens.specimens(spark, SF).rdd.getNumPartitions() == 5


def test_files_are_read_once(spark):
    for run in (specimens.syntax_imports, specimens.syntax_symbols):
        assert "MapInArrow" not in run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_packages_stay_one_row_until_edges_are_asked_for(spark, monkeypatch):
    """An import of a Go package is one row, and only edges name all its files; of an edge that is there by itself the lower line stays."""
    files = frame(spark, [(f"m/f{k}.go",) for k in range(40)] + [("n/g.go",)], "path string")
    rows = [(f"m/f{k}.go", "go", "ex.org/r/m", 5, "import") for k in range(40)]
    rows += [("m/f0.go", "go", "ex.org/r/m", 9, "import"), ("m/f0.go", "go", "./f1.go", 3, "import"), ("m/f0.go", "go", "./f2.go", 7, "import"), ("m/f0.go", "go", "./f2.go", 8, "include"), ("n/g.go", "go", "ex.org/r/no", 1, "import")]
    imports = frame(spark, rows, "path string, language string, specifier string, line long, kind string")
    assert resolve._found(imports, files, "ex.org/r").count() == len(rows)
    monkeypatch.setattr(resolve, "PAIRS", 100)
    made = resolve.build_graph(imports, files, "ex.org/r")
    got = {(r["src"], r["dst"], r["kind"]): (r["line"], r["confidence"]) for r in made.edges.collect()}
    want = {(f"m/f{a}.go", f"m/f{b}.go", "import"): (5, 0.9) for a in range(40) for b in range(40) if a != b}
    want |= {("m/f0.go", "m/f1.go", "import"): (3, 1.0), ("m/f0.go", "m/f2.go", "include"): (8, 1.0)}
    assert got == want and made.edges.count() == len(want)
    assert [tuple(r) for r in made.external_by_file.collect()] == [("n/g.go", "ex.org/r/no", 1)] and made.unresolved.first()[0] == 0


def test_a_log_is_read_in_runs(spark, monkeypatch):
    monkeypatch.setattr(git, "RUN", 3)
    text = ["lost", "\x01a\x01ann\x012024-01-02T00:00:00Z", "", "x", "y", "z", "u", "\x01b\x01bob\x012024-01-01T00:00:00Z", "x", "\x01c\x01bob\x012024-01-01T00:00:00Z", "\x01d\x01di\x012023-01-01T00:00:00Z", "w"]
    got = git.parse_log(frame(spark, [(r, k, t) for r in ("one", None) for k, t in enumerate(text)], "repo string, seq long, text string")).drop("ts").collect()
    own = [("a", "ann", p, 1) for p in "xyzu"] + [("b", "bob", "x", 2), ("d", "di", "w", 4)]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r, *x)) for r in ("one", None) for x in own)


def test_an_index_is_built_by_many_tasks_of_one_small_file(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(trigrams, "ROWS", 100)
    rows = spark.range(1000).selectExpr("id as k", "concat('name ', id) as name").coalesce(1)
    found = trigrams.build(rows, "name", f"file://{tmp_path}/index")
    assert found.rows.count() == 1000 and len(found.rows.inputFiles()) == 10
    assert found.search("name 77", 1, 0.5, ["k"]).first()["row"]["k"] == 77
