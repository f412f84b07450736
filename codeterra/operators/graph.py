"""Dependency graph operators on edges(src, dst): degrees, selections, cycles, reach, and reading order.

The iterative ones deal connected components of at most KERNEL edges to tasks, each solved there at any depth. One of at most
PACKED edges is solved as arrays (see packed.py). A larger one is cut into blocks (see blocks.py) and is never gathered.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeterra.operators import blocks, packed
from codeterra.operators.components import components
from codeterra.session import checkpointed, forget, written

#: Edges of the largest component that one task solves as lists.
KERNEL = 1_000_000
#: Edges of the largest component that one task solves as arrays: 1.2 GB, 12 bytes an edge (more for a moment when reach is planned over cycles).
PACKED = 100_000_000
#: Edges of small components that are dealt to one task.
GROUP = 100_000
#: Bits of reach that a task holds at a time: 64 MB.
BITS = 1 << 29
#: Nodes times edges of a component whose reach one task counts; of larger ones each task counts a part.
REACH = 10**11


def first_edges(edges: DataFrame) -> DataFrame:
    """edges(src, dst, kind, line, ...) without self loops; of those with one (src, dst, kind) the one of the lowest line."""
    rank = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("line"))
    return edges.where("src <> dst").withColumn("rank", rank).where("rank = 1").drop("rank")


def dependents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("dependencies"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def within(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose two ends are in chosen(node)."""
    kept = edges.join(chosen.select(F.col("node").alias("src")), "src", "left_semi")
    return kept.join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes with the most dependents, ties by node."""
    return nodes(edges).join(dependents(edges), "node", "left").fillna(0, ["dependents"]).orderBy(F.desc("dependents"), "node").limit(n)


def neighbours(edges: DataFrame, node) -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("side"), F.col("dst").alias("node"))
    return out.union(edges.where(F.col("dst") == node).select(F.lit("in").alias("side"), F.col("src").alias("node"))).distinct()


def dead(all_nodes: DataFrame, edges: DataFrame, is_entry: Column) -> DataFrame:
    """Nodes nothing depends on, entry points aside."""
    return all_nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").where(~is_entry)


def _short(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select("src", "dst").distinct()


def split(edges: DataFrame) -> DataFrame:
    """edges(src, dst), each once and without loops, with low, by which their connected component is known, and its numbers of edges and nodes, n and nodes.

    cycles(), blast_radius() and reading_levels() take this for the edges, so that what runs several of them looks for components once.
    """
    edges = checkpointed(_short(edges).select("*", F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")))
    low = components(edges.select("u", "v"))
    own = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("own"))
    # sizes meet nodes and not edges, which would all go to one task by the name of a component that is nearly all
    of = written(low.join(own, "node", "full").select("node", F.coalesce("low", "node").alias("low"), "own"))
    sizes = of.groupBy("low").agg(F.sum("own").alias("n"), F.count("*").alias("nodes"))
    facts = of.join(sizes, "low").select(F.col("node").alias("u"), "low", "n", "nodes")
    made = checkpointed(edges.join(facts, "u").select("src", "dst", "low", "n", "nodes"))
    forget(of)
    return made


def _by_component(edges: DataFrame, kernel, schema: str, wide, beyond, most: int, reach: int | None = None) -> DataFrame:
    """kernel over connected components of at most `most` edges, several to a task; wide(edges) for larger ones of at most PACKED, beyond(edges) for the rest.

    With reach, a component of more nodes times edges than that is given to several tasks, each with its number and theirs.
    """
    edges = edges if {"low", "n", "nodes"} <= set(edges.columns) else split(edges)
    small, large = edges.where(F.col("n") <= most), edges.where(F.col("n") > max(most, PACKED))
    middle = edges.where((F.col("n") > most) & (F.col("n") <= PACKED))
    if reach:
        small = small.withColumn("parts", F.floor(F.col("nodes") * F.col("n") / reach) + 1).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    groups = max(1, -(-small.count() // GROUP))
    keys = ["low", "part", "parts"] if reach else ["low"]
    dealt = small.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group"), *keys, "src", "dst")
    out = dealt.groupBy("group").applyInPandas(kernel, schema)
    out = out if middle.isEmpty() else out.union(wide(middle.select("src", "dst", "low")))
    return out if large.isEmpty() else out.union(beyond(large.select("src", "dst")))


def _numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """Nodes in order, and for each the places of those it points to and of those that point to it."""
    nodes, ends = np.unique(np.concatenate((pdf["src"].to_numpy(), pdf["dst"].to_numpy())), return_inverse=True)
    out: list[list[int]] = [[] for _ in nodes]
    into: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(ends[: len(pdf)].tolist(), ends[len(pdf) :].tolist()):
        out[a].append(b)
        into[b].append(a)
    return nodes, out, into


def strong_components(out: list[list[int]]) -> list[list[int]]:
    """By one depth-first walk on an explicit stack; a component comes after all that it can reach."""
    order, low, stack, found, n = [-1] * len(out), [0] * len(out), [], [], 0
    held = [False] * len(out)
    for root in range(len(out)):
        if order[root] >= 0:
            continue
        path = [(root, iter(out[root]))]
        order[root] = low[root] = n
        n += 1
        stack.append(root)
        held[root] = True
        while path:
            node, rest = path[-1]
            for other in rest:
                if order[other] < 0:
                    order[other] = low[other] = n
                    n += 1
                    stack.append(other)
                    held[other] = True
                    path.append((other, iter(out[other])))
                    break
                if held[other]:
                    low[node] = min(low[node], order[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    component = []
                    while not component or component[-1] != node:
                        component.append(stack.pop())
                        held[component[-1]] = False
                    found.append(component)
    return found


def _cycle_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, out, _ = _numbered(pdf)
    found = [c for c in strong_components(out) if len(c) > 1]
    of = np.array([x for c in found for x in c], dtype=np.int64)
    first = np.repeat(np.array([min(c) for c in found], dtype=np.int64), [len(c) for c in found])
    return pd.DataFrame({"node": nodes[of], "cycle": nodes[first]})


def _blast_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    found = _part_of_reach(pdf.assign(low=0), 0, 1)
    return found.assign(blast=found["blast"] - 1)[found["blast"] > 1]


def _reach_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    made = [_part_of_reach(rows, *key) for key, rows in pdf.groupby(["part", "parts"], sort=False)]
    return pd.concat(made, ignore_index=True)


def _part_of_reach(pdf: pd.DataFrame, part: int, parts: int) -> pd.DataFrame:
    """edges(src, dst) with their connected component low -> (node, blast): how many nodes of one part of its component lead to each, itself included.

    Over the condensed graph, as integers with a bit for each of as many nodes as BITS allows at a time.
    """
    nodes, out, into = _numbered(pdf)
    low = np.empty(len(nodes), dtype=np.int64)
    for c in ("src", "dst"):
        low[np.searchsorted(nodes, pdf[c].to_numpy())] = pdf["low"].to_numpy()
    # dependents come before what they use, and connected components one after the other
    comps = strong_components(into)
    comps = [comps[k] for k in np.argsort(low[[c[0] for c in comps]], kind="stable").tolist()]
    place = np.empty(len(nodes), dtype=np.int64)
    for k, c in enumerate(comps):
        place[c] = k
    comp_of = place.tolist()
    below = [sorted({comp_of[y] for x in c for y in into[x]} - {k}) for k, c in enumerate(comps)]
    ends = np.cumsum([len(c) for c in comps]).tolist()  # nodes are numbered in this order
    cuts = np.flatnonzero(np.diff(low[[c[0] for c in comps]])) + 1
    blast = [0] * len(comps)
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(comps)]):
        first = ends[begin] - len(comps[begin])
        many = ends[end - 1] - first
        width = max(64, BITS // (end - begin))
        for at in range(first + many * part // parts, first + many * (part + 1) // parts, width):
            stop = min(at + width, first + many * (part + 1) // parts)
            start = bisect_right(ends, at)
            bits = [0] * (end - start)
            for k in range(start, end):
                left, right = max(ends[k] - len(comps[k]), at) - at, min(ends[k], stop) - at
                found = (1 << right) - (1 << left) if left < right else 0
                for b in below[k]:
                    if b >= start:
                        found |= bits[b - start]
                if found:
                    bits[k - start] = found
                    blast[k] += found.bit_count()
    n = np.array(blast, dtype=np.int64)[place]
    return pd.DataFrame({"node": nodes, "blast": n})


def _level_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of nodes that are in no cycle and above none; the others' are missing."""
    nodes, out, into = _numbered(pdf)
    left, level = [len(x) for x in out], [-1] * len(nodes)
    front, depth = [k for k, n in enumerate(left) if not n], 0
    while front:
        after = []
        for k in front:
            level[k] = depth
            for other in into[k]:
                left[other] -= 1
                if not left[other]:
                    after.append(other)
        front, depth = after, depth + 1
    return pd.DataFrame({"node": nodes, "level": pd.array([None if x < 0 else x for x in level], dtype="Int64")})


def _kind(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def blast_radius(edges: DataFrame, most: int = KERNEL) -> DataFrame:
    """(node, blast) of nodes with dependents: how many others depend on it, directly or not."""
    counted = _by_component(edges, _reach_rows, f"node {_kind(edges)}, blast long", packed.reach, lambda large: _large_blast(large).withColumn("blast", F.col("blast") + 1), most, REACH)
    return counted.groupBy("node").agg((F.sum("blast") - 1).alias("blast")).where("blast > 0")  # without the node itself


def capped(blast: Column, most: int = 2000) -> Column:
    """The number that readers who count no further are shown."""
    return F.least(blast, F.lit(most))


def cycles(edges: DataFrame, most: int = KERNEL) -> DataFrame:
    """(node, cycle) of strongly connected components of two nodes or more; cycle is the smallest node."""
    kind = _kind(edges)
    return _by_component(edges, _cycle_rows, f"node {kind}, cycle {kind}", packed.cycles, _large_cycles, most)


def cycle_list(found: DataFrame, most: int = 50) -> DataFrame:
    """cycles() as (cycle, size, nodes), the `most` largest, ties by name; nodes sorted."""
    sizes = found.groupBy("cycle").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cycle").limit(most)
    return found.join(F.broadcast(sizes), "cycle").groupBy("cycle", "size").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # `most` rows


def _with_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst) as edges(a, b) of longs, and (id, node)."""
    number = (lambda c: F.col(c).cast("long")) if _kind(edges) in ("bigint", "int", "smallint", "tinyint") else F.xxhash64
    named = edges.where("src <> dst").select(number("src").alias("a"), number("dst").alias("b"), "src", "dst")
    pairs = F.array(F.struct(F.col("a").alias("id"), F.col("src").alias("node")), F.struct(F.col("b").alias("id"), F.col("dst").alias("node")))
    ids = named.select(F.explode(pairs).alias("x")).select("x.*").distinct()
    return checkpointed(named.select("a", "b").distinct()), checkpointed(ids)


def _large_cycles(edges: DataFrame) -> DataFrame:
    """cycles() in blocks."""
    pairs, ids = _with_ids(edges)
    found = blocks.strong(pairs, strong_components).withColumnRenamed("node", "id").join(ids, "id")
    first = found.groupBy("name").agg(F.min("node").alias("cycle"))
    return found.join(first, "name").select("node", "cycle")


def _large_blast(edges: DataFrame) -> DataFrame:
    """blast_radius() in blocks, over the graph with each strong component as one node of its size."""
    pairs, ids = _with_ids(edges)
    names = checkpointed(blocks.strong(pairs, strong_components))
    sizes = checkpointed(names.groupBy(F.col("name").alias("node")).agg(F.count("*").alias("size")))
    short = checkpointed(blocks._renamed(pairs, names))
    counts = sizes.select("node", F.col("size").alias("value"))
    if not short.isEmpty():
        some = checkpointed(blocks.reach(short, sizes))
        counts = some.union(counts.join(some.select("node"), "node", "left_anti"))
    of = ids.join(names.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("name", "id").alias("name"))
    return of.join(counts.withColumnRenamed("node", "name"), "name").where("value > 1").select("node", (F.col("value") - 1).alias("blast"))


def reading_levels(edges: DataFrame, most: int = KERNEL) -> DataFrame:
    """(node, level): dependencies first, a node's level is one above its highest dependency's; nodes in or above cycles get the level after the last."""
    levels = checkpointed(_by_component(edges, _level_rows, f"node {_kind(edges)}, level long", packed.levels, _large_levels, most))
    last = levels.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("last"))
    return levels.join(F.broadcast(last)).select("node", F.coalesce("level", "last").cast("int").alias("level"))  # one row


def _large_levels(edges: DataFrame) -> DataFrame:
    """Levels in blocks; null for nodes in or above cycles."""
    pairs, ids = _with_ids(edges)
    upward = blocks.reversed_edges(pairs)
    found = blocks.levels(upward, blocks.blocks(upward)).withColumnRenamed("node", "id")
    return found.join(ids, "id").select("node", F.when(F.col("value") >= 0, F.col("value")).alias("level"))


def order_of(levels: DataFrame) -> DataFrame:
    """levels with place: the node's place within its level."""
    return levels.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("node")))


def importance(facts: DataFrame) -> Column:
    return 3 * F.col("dependents") + F.col("blast") + F.col("churn") / 2 + F.when(F.col("entry"), 5).otherwise(0)
