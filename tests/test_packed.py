"""Graph operators on arrays against those on lists."""

import random

import numpy as np
import pandas as pd
import pytest

from codeterra.operators import graph, packed
from tests.conftest import frame
from tests.test_blocks import rambling


def never(*_):
    raise AssertionError("a component that arrays hold")


@pytest.mark.parametrize("blocks", [False, True])
def test_components_beyond_lists(spark, monkeypatch, blocks):
    """Two components with cycles and loops, of texts; blocks are only for what arrays don't hold."""
    edges = [(f"{c}{a}", f"{c}{b}") for c, n in (("x", 140), ("y", 90)) for a, b in rambling(n, n)]
    pdf = pd.DataFrame(edges, columns=["src", "dst"])
    short = pdf[pdf.src != pdf.dst]
    if blocks:
        monkeypatch.setattr(graph, "PACKED", 0)
    else:
        for name in ("_large_cycles", "_large_levels", "_large_blast"):
            monkeypatch.setattr(graph, name, never)
        monkeypatch.setattr(packed, "WORK", 1000)
        monkeypatch.setattr(packed, "BITS", 64)
        monkeypatch.setattr(packed, "WIDTH", 64)
        monkeypatch.setattr(packed, "CHUNK", 50)
    df = frame(spark, edges[:200] + [(f"z{k}", f"z{k + 1}") for k in range(3)] if blocks else edges, "src string, dst string")
    if blocks:
        pdf = pd.DataFrame([tuple(r) for r in df.collect()], columns=["src", "dst"])
        short = pdf[pdf.src != pdf.dst]
    levels = graph._level_rows(short)
    last = levels["level"].max() + 1 if levels["level"].notna().any() else 0
    split = graph.split(df)
    assert {tuple(r) for r in graph.cycles(split, 20).collect()} == set(graph._cycle_rows(short).itertuples(index=False, name=None))
    assert {tuple(r) for r in graph.reading_levels(split, 20).collect()} == {(n, int(last if pd.isna(v) else v)) for n, v in levels.itertuples(index=False)}
    if not blocks:
        assert {tuple(r) for r in graph.blast_radius(split, 20).collect()} == set(graph._blast_rows(short).itertuples(index=False, name=None))


def test_plans_of_any_shape(monkeypatch):
    """Cycles, hubs and deep paths, with rows of several widths and groups of several sizes, by one part and by three."""
    for seed in range(30):
        rng = random.Random(seed)
        n = rng.choice([5, 30, 150])
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(n * rng.choice([1, 2, 5]))}
        pairs = {(max(e), min(e)) for e in pairs} if seed % 3 == 0 else pairs
        pairs |= {(k, k + 1) for k in range(n - 1)} if seed % 5 == 0 else set()
        pairs |= {(0, k) for k in range(1, n)} | {(k, n - 1) for k in range(n - 1)} if seed % 7 == 0 else set()
        pdf = pd.DataFrame(sorted((a, b) for a, b in pairs if a != b), columns=["src", "dst"])
        names, ends = np.unique(pdf.to_numpy().T.ravel(), return_inverse=True)
        for name, value in zip(("BITS", "WIDTH", "FEW", "CACHE"), rng.choice([(1 << 30, 256, 16, 1 << 19), (64, 64, 2, 64), (64, 64, 16, 1 << 10), (1 << 30, 256, 1, 256)])):
            monkeypatch.setattr(packed, name, value)
        rows = [(r["kind"], r["place"], r["data"]) for b in packed._planned(ends[: len(pdf)] << 32 | ends[len(pdf) :], len(names)) for r in b.to_pylist()]
        *plan, place = [packed._together(rows, kind) for kind in range(5)]
        parts = rng.choice([1, 3])
        got = sum(packed.Plan(*plan).count(k, parts) for k in range(parts))[place] - 1
        assert {names[k]: v for k, v in enumerate(got.tolist()) if v} == dict(graph._blast_rows(pdf).itertuples(index=False))


def test_a_component_of_all_edges_stays_in_many_tasks(spark):
    """Edges are not dealt by the name of their component; before, those of one component all came to one task."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = graph.split(spark.range(4000).selectExpr("id as src", "id + 1 as dst"))
        sizes = found.rdd.glom().map(len).collect()
        assert sum(sizes) == 4000 and max(sizes) < 2000 and {tuple(r) for r in found.select("n", "nodes").distinct().collect()} == {(4000, 4001)}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
