"""Connected components: what rounds cost, and that they are looked for once."""

from pyspark.sql import functions as F

from codeterra.operators import components as module
from codeterra.operators import graph
from tests.conftest import frame


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    """Each round holds fewer links, so that all together hold a few times the links, at any order of the path's names; before, each round held all of them."""
    held = []
    name = "written" if hasattr(module, "written") else "cut"
    keep = getattr(module, name)

    def noted(df):
        made = keep(df)
        if made.columns == ["u", "v"]:
            held.append(made.count())
        return made

    monkeypatch.setattr(module, name, noted)
    links = spark.range(6000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = module.components(links, 50).collect()
    assert len(got) == 6001 and {r["low"] for r in got} == {0}
    assert held[0] == 6000 and all(b < 0.75 * a for a, b in zip(held, held[1:]))


def test_a_split_graph_gives_the_same(spark, monkeypatch):
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 1), (6, 7), (7, 6), (1, 2)], "src long, dst long")
    whole = graph.split(edges)
    for run in (graph.cycles, graph.blast_radius, graph.reading_levels):
        assert sorted(map(tuple, run(whole).collect())) == sorted(map(tuple, run(edges).collect()))
        assert sorted(map(tuple, run(whole, 2).collect())) == sorted(map(tuple, run(edges, 2).collect()))


def test_reading_steps_look_for_components_once(spark, monkeypatch):
    from codeterra.plans import structure

    calls, real = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links: calls.append(1) or real(links))
    assert structure.reading_steps(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_health_score_makes_its_links_once(spark, monkeypatch):
    """Nodes, dead ones, cycles and the number of links read one copy; before, each made the links anew."""
    from codeterra.plans import structure, tables

    made, links = spark.sparkContext.accumulator(0), tables.links(spark, "/root/testdata/sf0.001").collect()

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    want = structure.health_score(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(tables, "links", lambda s, d: frame(s, links, "src long, dst long").withColumn("src", counted.asNondeterministic()("src")))
    assert structure.health_score(spark, "/root/testdata/sf0.001").collect() == want and made.value == len(links)


def test_comprehension_makes_its_inputs_once(spark):
    """Files and symbols are computed for one pass, not one for each kind of claim, and prompts once."""
    from codeterra.operators import comprehension

    seen = {name: spark.sparkContext.accumulator(0) for name in ("files", "symbols", "prompts")}

    def counted(name, value):
        acc = seen[name]

        @F.udf("string")
        def run(x):
            acc.add(1)
            return x

        return run.asNondeterministic()(value)

    files = frame(spark, [("src/a.py", "python", 10, 2, 1, None), ("src/b.py", "python", 10, 2, 0, None)], "path string, language string, bytes long, loc int, dependents long, skip_reason string")
    symbols = frame(spark, [("src/a.py", 1, "f", "function")], "path string, line long, name string, kind string")
    contents = frame(spark, [("src/a.py", "x"), ("src/b.py", "y")], "path string, text string")
    found = comprehension.comprehend(files.withColumn("language", counted("files", F.col("language"))), contents, symbols.withColumn("name", counted("symbols", F.col("name"))), frame(spark, [], "src string, dst string"), "o/n", lambda prompt: "none")
    assert found.modules.count() == 1 and found.files.count() == 2 and found.repo.count() == 1
    said = comprehension.replies(frame(spark, [("a", "p"), ("b", "p")], "id string, prompt string").withColumn("prompt", counted("prompts", F.col("prompt"))), lambda prompt: "r")
    assert {tuple(r) for r in said.collect()} == {("a", "r", None), ("b", "r", None)}
    assert {name: acc.value for name, acc in seen.items()} == {"files": 2, "symbols": 1, "prompts": 2}
