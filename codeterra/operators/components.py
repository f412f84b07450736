"""Connected components of a link table by rounds of contraction, until one task holds the links that are left.

In a round each node joins the first of its neighbours and itself in an order that is drawn anew each time; links between those
that were joined go. So links halve, about, from round to round at any length of path, and all rounds together cost about as much as
the first two. Then the names are handed back from round to round. Rows never outnumber the links by more than the two directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.session import forget, written

#: Links that one task contracts at last.
EDGES = 200_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is not the smallest of its component, with the smallest."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    low = np.array([top(x) for x in range(len(nodes))], dtype=np.int64)
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        yield pa.record_batch([pa.array(x) for x in _stars(*map(np.concatenate, zip(*held)))], names=["u", "v"])


def _joined(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): each node with the first of its neighbours and itself, in the order of this turn."""
    place = lambda c: F.xxhash64(c, F.lit(turn))
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy(F.col("u").alias("node")).agg(F.min_by("v", place("v")).alias("v"))
    return first.select("node", F.when(place("v") < place("node"), F.col("v")).otherwise(F.col("node")).alias("to"))


def _once(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most: int = EDGES) -> DataFrame:
    """links(u, v) of longs, in either direction, repeats and self-links allowed -> (node, low): each linked node with the smallest node it reaches.

    Nodes without links are not returned; links with a null end are ignored; no links give no rows.
    """
    edges, steps = written(_once(links)), []
    while edges.count() > most:
        steps.append(written(_joined(edges, len(steps))))
        to = lambda c: steps[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        old, edges = edges, written(_once(edges.join(to("u"), "u").join(to("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))))
        forget(old)
    stars = edges.coalesce(1).mapInArrow(_contract, "u long, v long")  # at most `most` rows
    found = written(stars.union(stars.select("v", "v").distinct()).toDF("node", "low"))
    forget(edges)
    if not steps:
        return found
    for step in reversed(steps):
        old, found = found, written(step.join(found.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("low", "to").alias("low")))
        forget(old, step)
    first = found.groupBy("low").agg(F.min("node").alias("first"))
    return written(found.join(first, "low").select("node", F.col("first").alias("low")))
