"""Graph operators in blocks against those of one task."""

import random

import pandas as pd
import pytest

from codeterra.operators import blocks, graph
from tests.conftest import frame


def rambling(seed, n=140):
    """A long path with short ways around, trees on it, and cycles, by names in no order."""
    rng = random.Random(seed)
    name = list(range(n))
    rng.shuffle(name)
    edges = {(name[k], name[k + 1]) for k in range(n // 2)} | {(name[k], name[k + 2]) for k in range(0, n // 2, 3)}
    edges |= {(name[k], name[rng.randrange(max(0, k - 20), k)]) for k in range(n // 2 + 3, n) for _ in range(2)}
    return sorted(edges | {(name[k + 6], name[k]) for k in range(0, n // 2, 40)} | {(name[n - 1], name[n - 1])})


@pytest.fixture(scope="module")
def told(spark):
    edges = rambling(4)
    return edges, graph._with_ids(frame(spark, edges, "src long, dst long"))[0]


def test_blocks_are_bounded_and_whole(spark, told):
    edges, pairs = told
    for merged in (10_000, 60):  # by one task, and by rounds before it
        found = blocks.blocks(pairs, 90, merged).collect()
        assert len(found) == len({x for e in edges for x in e}) and len({r["node"] for r in found}) == len(found)
        ends = {}
        for r in found:
            ends[r["block"]] = ends.get(r["block"], 0) + sum((r["node"] == a) + (r["node"] == b) for a, b in edges if a != b)
        assert max(ends.values()) <= 2 * 90 and len(ends) < 60  # who asks is drawn, so bounds hold about


@pytest.mark.parametrize("merged", [0, 1000])
def test_strong_components(spark, told, merged):
    edges, pairs = told
    want = graph._cycle_rows(pd.DataFrame(edges, columns=["src", "dst"]))
    groups = {}
    for r in blocks.strong(pairs, graph.strong_components, 200, merged).collect():
        groups.setdefault(r["name"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for _, x in want.groupby("cycle")["node"])


def test_levels_and_reach(spark, told):
    edges, pairs = told
    pdf = pd.DataFrame(edges, columns=["src", "dst"])
    upward = blocks.reversed_edges(pairs)
    got = {r["node"]: r["value"] for r in blocks.levels(upward, blocks.blocks(upward, 200)).collect()}
    assert got == {n: -1 if pd.isna(v) else int(v) for n, v in zip(*graph._level_rows(pdf[pdf.src != pdf.dst])[["node", "level"]].to_numpy(dtype=object).T)}
    down = frame(spark, [(a, b) for a, b in edges if a < b], "a long, b long")
    pdf = pd.DataFrame([e for e in edges if e[0] < e[1]], columns=["src", "dst"])
    sizes = frame(spark, [], "node long, size long")
    got = {r["node"]: r["value"] - 1 for r in blocks.reach(down, sizes, 200, 64).collect() if r["value"] > 1}
    assert got == dict(graph._blast_rows(pdf).itertuples(index=False))


def test_whole_operators_beyond_one_task(spark):
    """By texts, with components of either kind; a component that is one cycle has no edge left after it is one node."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("p", "p"), ("q", "r"), ("a", "b")]
    df = frame(spark, edges, "src string, dst string")
    for most in (2,):
        assert {r["node"]: r["cycle"] for r in graph.cycles(df, most).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
        assert {r["node"]: r["blast"] for r in graph.blast_radius(df, most).collect()} == {"a": 2, "b": 2, "c": 2, "d": 3, "e": 4, "x": 1, "y": 1, "r": 1}
        assert {r["node"]: r["level"] for r in graph.reading_levels(df, most).collect()} == {"e": 0, "r": 0, "d": 1, "q": 1, "a": 2, "b": 2, "c": 2, "x": 2, "y": 2}


def test_order_graphs_by_brute_force(spark):
    """The registered queries on one component against plain walks."""
    from codeterra.plans import structure, tables

    path = "/root/testdata/sf0.001"
    edges = [tuple(r) for r in tables.edges(spark, path).select("src", "dst").collect()]

    def leads_to(pairs):
        into = {}
        for a, b in pairs:
            into.setdefault(b, set()).add(a)
        out = {}
        for node in into:
            seen, left = set(), [node]
            while left:
                for x in into.get(left.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        left.append(x)
            out[node] = seen
        return out

    reach = leads_to(edges)
    loops = {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in reach if n in reach[n]}
    assert {r["node"]: r["cycle"] for r in structure.order_cycles(spark, path).collect()} == loops
    down = [e for e in edges if e[0] > e[1]]
    assert {r["node"]: r["blast"] for r in structure.order_blast(spark, path).collect()} == {n: len(x) for n, x in leads_to(down).items()}
    level = {}
    for a, b in sorted(down):
        level[b] = level.get(b, 0)
        level[a] = max(level.get(a, 0), level[b] + 1)
    assert {r["node"]: r["level"] for r in structure.order_levels(spark, path).collect()} == level


def test_a_wide_component_is_solved_in_one_task(spark, monkeypatch):
    """Of 450,000 edges between 20,000 parts, all in one component, nothing goes to the blocks, and work is no square of it."""
    from codeterra.plans import structure

    def never(*_):
        raise AssertionError("a component of fewer than a million edges")

    for name in ("_large_cycles", "_large_levels", "_large_blast"):
        monkeypatch.setattr(graph, name, never)
    for run in (structure.order_cycles, structure.order_levels, structure.order_blast):
        assert run(spark, "/root/testdata/sf0.1").count() > 18_000


def test_one_cycle_takes_no_square_of_its_nodes(monkeypatch):
    """The smallest node of a component is looked for once, not once for each of its nodes."""
    calls = []
    monkeypatch.setattr(graph, "min", lambda *x: calls.append(x) or min(*x), raising=False)
    got = graph._cycle_rows(pd.DataFrame({"src": range(500), "dst": [(k + 1) % 500 for k in range(500)]}))
    assert len(got) == 500 and set(got["cycle"]) == {0} and sum(isinstance(x[0], list) for x in calls) == 1
    assert graph._cycle_rows(pd.DataFrame({"src": ["a"], "dst": ["b"]})).empty


@pytest.mark.parametrize("bits", [1, 1 << 29])
def test_reach_in_parts(spark, monkeypatch, bits):
    """A component whose reach several tasks count, a few nodes at a time."""
    edges = rambling(7)
    want = dict(graph._blast_rows(pd.DataFrame(edges, columns=["src", "dst"])).itertuples(index=False))
    pdf = pd.DataFrame([e for e in edges if e[0] != e[1]], columns=["src", "dst"]).assign(low=5)
    monkeypatch.setattr(graph, "BITS", bits)
    parts = pd.concat([graph._part_of_reach(pdf, k, 3) for k in range(3)]).groupby("node")["blast"].sum() - 1
    assert {n: b for n, b in parts.items() if b} == want
    monkeypatch.setattr(graph, "REACH", 5_000)
    assert {r["node"]: r["blast"] for r in graph.blast_radius(frame(spark, edges, "src long, dst long")).collect()} == want
