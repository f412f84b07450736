"""Operators on graphs that no task holds, in blocks: regions of the graph that tasks solve whole, and values exchanged between them.

A graph is cut into blocks of bounded size by merging neighbours, so long paths run inside blocks. A block knows its
nodes, the edges into them and the nodes of other blocks that these come from (its guests). A step solves a block at
any depth, given what its guests have; nodes whose value changed are sent to the blocks that have them as guests. Steps end when
nothing changes: there are as many as blocks that the deciding path enters, not as many as it has edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeterra.session import forget, written

#: Edge ends in a block, about; a node with more is a block of its own.
SIZE = 600_000
#: Links between clusters that one task merges at last.
MERGED = 200_000
#: Nodes whose reach is one row of bits.
BITS = 1 << 12


def _greedy(size: int):
    """Links (u, v, w, size_u, size_v) of all clusters -> (node, block), heaviest links first, no block above size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(np.concatenate((pdf["u"].to_numpy(), pdf["v"].to_numpy())), return_inverse=True)
        held = np.zeros(len(nodes), dtype=np.int64)
        held[ends] = np.concatenate((pdf["size_u"].to_numpy(), pdf["size_v"].to_numpy()))
        held, above = held.tolist(), list(range(len(nodes)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        left, right = ends[: len(pdf)], ends[len(pdf) :]
        for k in np.argsort(-pdf["w"].to_numpy(), kind="stable").tolist():
            a, b = top(int(left[k])), top(int(right[k]))
            if a != b and held[a] + held[b] <= size:
                above[max(a, b)] = min(a, b)
                held[min(a, b)] = held[a] + held[b]
        return pd.DataFrame({"node": nodes, "block": nodes[[top(k) for k in range(len(nodes))]]})

    return run


def blocks(edges: DataFrame, size: int = SIZE, merged: int = MERGED) -> DataFrame:
    """edges(a, b) of longs -> (node, block), block being one of its nodes.

    Rounds of merging: by a coin each cluster waits or asks a waiting neighbour to take it, the one with most links; who is
    asked by more than it has room for takes a part of them. When few links between clusters are left, one task merges the rest.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    label = written(ends.groupBy("node").agg(F.count("*").alias("size")).withColumn("block", F.col("node")))
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).groupBy("u", "v").agg(F.count("*").alias("w")))
    turn, idle = 0, 0
    while links.count() > merged and idle < 4:
        turn += 1
        sizes = written(label.groupBy("block").agg(F.sum("size").alias("size")))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
        both = links.select("u", "v", "w").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).where(coin("u") & ~coin("v"))
        asks = both.join(sizes.select(F.col("block").alias("u"), F.col("size").alias("size_u")), "u").join(sizes.select(F.col("block").alias("v"), F.col("size").alias("size_v")), "v").where(F.col("size_u") + F.col("size_v") <= size)
        best = asks.groupBy("u").agg(F.max_by(F.struct("v", "size_u", "size_v"), F.struct("w", F.xxhash64("u", "v"))).alias("x")).select("u", "x.*")
        wanted = best.groupBy("v").agg(F.sum("size_u").alias("wanted"))
        drawn = F.pmod(F.xxhash64("u", F.lit(-turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moves = written(best.join(wanted, "v").where(drawn < (F.lit(size) - F.col("size_v")) / F.col("wanted")).select(F.col("u").alias("from"), F.col("v").alias("to")))
        idle = idle + 1 if moves.isEmpty() else 0
        moved = lambda df, c: df.join(moves, df[c] == moves["from"], "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
        label = written(moved(label, "block"))
        links = moved(moved(links, "u"), "v").where("u <> v")
        links = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.sum("w").alias("w")))
    if links.count() <= merged:
        sizes = label.groupBy("block").agg(F.sum("size").alias("size"))
        sized = links.join(sizes.select(F.col("block").alias("u"), F.col("size").alias("size_u")), "u").join(sizes.select(F.col("block").alias("v"), F.col("size").alias("size_v")), "v")
        last = sized.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_greedy(size), "node long, block long")  # at most `merged` rows
        last = last.select(F.col("node").alias("from"), F.col("block").alias("to"))
        label = label.join(last, label.block == last["from"], "left").select("node", F.coalesce("to", "block").alias("block"))
    return written(label.select("node", "block"))


class Region:
    """A block: its nodes, sorted, its guests after them, and edges (from, to) as places among both."""

    def __init__(self, nodes: bytes, guests: bytes, sources: bytes, targets: bytes):
        self.nodes, self.guests = np.frombuffer(nodes, dtype=np.int64), np.frombuffer(guests, dtype=np.int64)
        self.sources, self.targets = np.frombuffer(sources, dtype=np.int32), np.frombuffer(targets, dtype=np.int32)

    def following(self) -> list[list[int]]:
        """For each node and guest the places that its edges lead to."""
        out: list[list[int]] = [[] for _ in range(len(self.nodes) + len(self.guests))]
        for a, b in zip(self.sources.tolist(), self.targets.tolist()):
            out[a].append(b)
        return out

    def guest(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.guests, ids) + len(self.nodes)


_REGION = "block long, nodes binary, guests binary, sources binary, targets binary"


def _region(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = np.unique(pdf["b"].to_numpy(dtype=np.int64))
    real = pdf[pdf["a"] != pdf["b"]].drop_duplicates(["a", "b"])
    a, b = real["a"].to_numpy(dtype=np.int64), real["b"].to_numpy(dtype=np.int64)
    inside = np.isin(a, nodes)
    guests = np.unique(a[~inside])
    at = np.where(inside, np.searchsorted(nodes, a), len(nodes) + np.searchsorted(guests, a)).astype(np.int32)
    return pd.DataFrame({"block": [key[0]], "nodes": [nodes.tobytes()], "guests": [guests.tobytes()], "sources": [at.tobytes()], "targets": [np.searchsorted(nodes, b).astype(np.int32).tobytes()]})


class Blocks:
    """edges(a, b), a and b different, in blocks; values go from a to b."""

    def __init__(self, edges: DataFrame, label: DataFrame):
        to = edges.join(label.select(F.col("node").alias("b"), F.col("block")), "b")
        # a node stands with itself, so that one without an edge to it is there, too
        every = to.select("block", "a", "b").union(label.select("block", "node", "node"))
        self.regions = written(every.groupBy("block").applyInPandas(_region, _REGION))
        of = label.select(F.col("node").alias("a"), F.col("block").alias("own"))
        self.sends = written(to.join(of, "a").where("own <> block").select(F.col("a").alias("node"), F.col("block").alias("to")).distinct())

    def run(self, step: Callable[[Region, np.ndarray | None, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: DataFrame | None = None) -> DataFrame:
        """(node, value long) once nothing changes.

        step gets a region, its state (an array of longs; at first what start(node, value) has of its nodes as (nodes,
        values) rows, or nothing), and the guests' places and values that are new; it gives the new state, whose first
        entries are its nodes' values, and the places of nodes whose value is to be sent.
        """
        schema = "block long, state binary, sent array<struct<node:bigint,value:bigint>>"
        state = self.regions.select("block", F.lit(None).cast("binary").alias("state"))
        news = None
        if start is not None:
            given = start.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("given"))
            state = state.join(given, "block", "left").select("block", "state", "given")
        else:
            state = state.withColumn("given", F.lit(None).cast("array<struct<node:bigint,value:bigint>>"))
        state = written(state)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    region = Region(*(row[c] for c in ("nodes", "guests", "sources", "targets")))
                    told = row["news"] or []
                    ids, values = np.array([x["node"] for x in told], dtype=np.int64), np.array([x["value"] for x in told], dtype=np.int64)
                    old = None if row["state"] is None else np.frombuffer(row["state"], dtype=np.int64).copy()
                    first = None if row["given"] is None else np.array([[x["node"], x["value"]] for x in row["given"]], dtype=np.int64).reshape(-1, 2)
                    made, changed = step(region, first if old is None else old, region.guest(ids), values)
                    sent = [{"node": n, "value": v} for n, v in zip(region.nodes[changed].tolist(), made[changed].tolist())]
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "state": made.tobytes(), "sent": sent}], schema=_STEP)

        while True:
            todo = state.join(self.regions, "block")
            todo = todo.withColumn("news", F.lit(None).cast("array<struct<node:bigint,value:bigint>>")) if news is None else todo.join(news, "block")
            done = written(todo.select("block", "state", "given", "news", "nodes", "guests", "sources", "targets").mapInArrow(solve, schema))
            told = done.select(F.explode("sent").alias("x")).select("x.*").join(self.sends, "node")
            old, news = news, written(told.groupBy(F.col("to").alias("block")).agg(F.collect_list(F.struct("node", "value")).alias("news")))
            forget(old)
            rest = state.join(done.select("block"), "block", "left_anti").select("block", "state")
            old, state = state, written(done.select("block", "state").union(rest).withColumn("given", F.lit(None).cast("array<struct<node:bigint,value:bigint>>")))
            forget(old, done)
            if news.isEmpty():
                break

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for nodes, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    nodes = np.frombuffer(nodes, dtype=np.int64)
                    yield pa.record_batch([pa.array(nodes), pa.array(np.frombuffer(found, dtype=np.int64)[: len(nodes)])], names=["node", "value"])

        return state.join(self.regions, "block").select("nodes", "state").mapInArrow(values, "node long, value long")


_STEP = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("sent", pa.list_(pa.struct([("node", pa.int64()), ("value", pa.int64())])))])


def _peel(region: Region, state: np.ndarray | None, guests: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State: levels (-1: not yet), how many edges still wait, and the level that is due."""
    n, out = len(region.nodes), region.following()
    if state is None or state.ndim == 2:
        state = np.concatenate((np.full(n, -1), np.bincount(region.targets, minlength=n), np.zeros(n, dtype=np.int64)))
        front = np.flatnonzero(state[n : 2 * n] == 0).tolist()
    else:
        front = []
    level, wait, due = state[:n].tolist(), state[n : 2 * n].tolist(), state[2 * n :].tolist()
    changed = []

    def told(a: int, value: int) -> None:
        for b in out[a]:
            wait[b] -= 1
            due[b] = max(due[b], value + 1)
            if not wait[b]:
                front.append(b)

    for g, value in zip(guests.tolist(), values.tolist()):
        told(g, value)
    while front:
        a = front.pop()
        level[a] = due[a]
        changed.append(a)
        told(a, level[a])
    return np.array([*level, *wait, *due], dtype=np.int64), np.array(changed, dtype=np.int64)


NEVER = np.iinfo(np.int64).max


def _least(region: Region, state: np.ndarray | None, guests: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State: the least value that has come to each node; at first those given, NEVER for others (all their own ids, if none are given at all)."""
    n, out = len(region.nodes), region.following()
    if state is None:
        state = np.full(n, NEVER)
        seeds = []
    elif state.ndim == 2:
        given, state = state, np.full(n, NEVER)
        at = np.searchsorted(region.nodes, given[:, 0])
        seeds = list(zip(given[:, 1].tolist(), at.tolist()))
    else:
        seeds = []
    best, changed = state.tolist(), set()
    seeds += [(v, b) for g, v in zip(guests.tolist(), values.tolist()) for b in out[g]]
    for value, at in sorted(seeds):
        front = [at]
        while front:
            a = front.pop()
            if value < best[a]:
                best[a] = value
                changed.add(a)
                front += out[a]
    return np.array(best, dtype=np.int64), np.array(sorted(changed), dtype=np.int64)


def levels(edges: DataFrame, label: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, value): the number of edges of the longest path to a node; -1 for nodes in a cycle and those that a cycle leads to."""
    return Blocks(edges, label).run(_peel)


def least(edges: DataFrame, start: DataFrame, label: DataFrame) -> DataFrame:
    """edges(a, b), start(node, value) -> (node, value): the least value of the nodes from which a path comes, its own included; NEVER if there is none."""
    return Blocks(edges, label).run(_least, start.join(label, "node").select("block", "node", "value"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _among(edges: DataFrame, kept: DataFrame) -> DataFrame:
    edges = edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi")
    return edges.join(kept.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges with ends as names(node, name) has them, each once, without loops."""
    for c in ("a", "b"):
        edges = edges.join(names.select(F.col("node").alias(c), F.col("name").alias("new")), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return edges.where("a <> b").select("a", "b").distinct()


def _local_components(components: Callable[[list[list[int]]], list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                region = Region(row["nodes"], row["guests"], row["sources"], row["targets"])
                found = [c for c in components(region.following()) if len(c) > 1]
                of = np.array([x for c in found for x in c], dtype=np.int64)
                name = np.repeat(np.array([min(c) for c in found], dtype=np.int64), [len(c) for c in found])
                yield pa.record_batch([pa.array(region.nodes[of]), pa.array(region.nodes[name])], names=["node", "name"])

    return run


def strong(edges: DataFrame, components: Callable[[list[list[int]]], list[list[int]]], size: int = SIZE, merged: int = MERGED) -> DataFrame:
    """edges(a, b) of longs -> (node, name) of strongly connected components of two nodes or more, name being one of them.

    In turn, until no edge is left: nodes that no cycle leads to, or that lead to none, go; what components() finds inside a
    block (one for all, when no more than `merged` edges are left) becomes one node; where there is nothing to find, each node takes the least node that leads to it as its colour, and
    those of a colour that lead back to its own node are a component, which goes.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct())
    names, done = None, None
    while not left.isEmpty():
        label = blocks(left, size)
        kept = levels(left, label).where("value < 0").select("node").join(levels(reversed_edges(left), label).where("value < 0").select("node"), "node")
        left = written(_among(left, written(kept)))
        if left.isEmpty():
            break
        label = blocks(left, size)
        if left.count() <= merged:
            label = written(label.select("node", F.lit(0).cast("long").alias("block")))
        inside = written(Blocks(left, label).regions.mapInArrow(_local_components(components), "node long, name long"))
        if not inside.isEmpty():
            names = inside if names is None else _composed(names, inside)
            left = written(_renamed(left, inside))
            continue
        everyone = label.select("node", F.col("node").alias("value"))
        colour = written(least(left, everyone, label))
        same = left.join(colour.select(F.col("node").alias("a"), F.col("value").alias("x")), "a").join(colour.select(F.col("node").alias("b"), F.col("value").alias("y")), "b")
        same = written(same.where("x = y").select("a", "b"))
        roots = colour.where("node = value")
        back = least(reversed_edges(same), roots, label) if not same.isEmpty() else roots
        found = written(back.where(F.col("value") != NEVER).select("node", F.col("value").alias("name")))
        names = found if names is None else _composed(names, found)
        rest = label.select("node").join(found.select("node"), "node", "left_anti")
        left = written(_among(left, rest))
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("name")).limit(0)
    return names.join(names.groupBy("name").count().where("count > 1").select("name"), "name", "left_semi").select("node", "name")


def _composed(names: DataFrame, more: DataFrame) -> DataFrame:
    """names(node, name) where more(node, name) has renamed some of the names, and knows new nodes."""
    then = more.select(F.col("node").alias("name"), F.col("name").alias("next"))
    old = names.join(then, "name", "left").select("node", F.coalesce("next", "name").alias("name"))
    return written(old.union(more.join(names.select("node"), "node", "left_anti").select("node", "name")))


def _numbered(label: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, node, first, size): nodes numbered by block, each from first on for as many as it stands for."""
    rows = label.join(sizes, "node", "left").select("block", "node", F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    sums = rows.groupBy("block").agg(F.sum("size").alias("sum"))  # a row for each block
    ahead = sums.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("ahead"))
    own = F.sum("size").over(Window.partitionBy("block").orderBy("node")) - F.col("size")  # SIZE nodes at most
    return rows.withColumn("own", own).join(ahead, "block").select("block", "node", (F.col("ahead") + F.col("own")).alias("first"), "size")


_BITS = "block long, part long, state binary, total array<struct<node:bigint,value:bigint>>, sent array<struct<node:bigint,bits:binary>>"


def _spread(bits: int):
    """One row of bits for each node: those of the nodes that lead to it, within one part of all numbers."""
    import zlib

    made = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("state", pa.binary()), ("total", pa.list_(pa.struct([("node", pa.int64()), ("value", pa.int64())]))), ("sent", pa.list_(pa.struct([("node", pa.int64()), ("bits", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                region = Region(row["nodes"], row["guests"], row["sources"], row["targets"])
                n, out = len(region.nodes), region.following()
                grid = np.zeros((n + len(region.guests), bits // 8), dtype=np.uint8)
                if row["state"] is not None:
                    grid[:n] = np.frombuffer(zlib.decompress(row["state"]), dtype=np.uint8).reshape(n, -1)
                else:
                    first, many = np.frombuffer(row["first"], dtype=np.int64), np.frombuffer(row["many"], dtype=np.int64)
                    low, high = first - row["part"] * bits, first + many - row["part"] * bits
                    for at in np.flatnonzero((low < bits) & (high > 0)).tolist():
                        own = np.zeros(bits, dtype=np.uint8)
                        own[max(low[at], 0) : high[at]] = 1
                        grid[at] = np.packbits(own, bitorder="little")
                before = np.bitwise_count(grid[:n]).sum(axis=1, dtype=np.int64) if row["state"] is not None else np.zeros(n, dtype=np.int64)
                for x in row["news"] or []:
                    grid[region.guest(np.array([x["node"]]))[0]] |= np.frombuffer(x["bits"], dtype=np.uint8)
                wait = np.bincount(region.targets, minlength=len(out)).tolist()
                some = grid.any(axis=1).tolist()
                front = [a for a, w in enumerate(wait) if not w]
                while front:
                    a = front.pop()
                    for b in out[a]:
                        if some[a]:
                            grid[b] |= grid[a]
                            some[b] = True
                        wait[b] -= 1
                        if not wait[b]:
                            front.append(b)
                count = np.bitwise_count(grid[:n]).sum(axis=1, dtype=np.int64)
                filled, changed = np.flatnonzero(count), np.flatnonzero(count != before)
                wanted = np.frombuffer(row["wanted"], dtype=np.int64) if row["wanted"] is not None else np.empty(0, dtype=np.int64)
                changed = changed[np.isin(region.nodes[changed], wanted)]
                total = [{"node": a, "value": b} for a, b in zip(region.nodes[filled].tolist(), count[filled].tolist())]
                sent = [{"node": int(region.nodes[c]), "bits": grid[c].tobytes()} for c in changed]
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "part": row["part"], "state": zlib.compress(grid[:n].tobytes(), 1), "total": total, "sent": sent}], schema=made)

    return run


def reach(edges: DataFrame, sizes: DataFrame, size: int = SIZE, bits: int = BITS) -> DataFrame:
    """edges(a, b) without cycles, sizes(node, size) -> (node, value): how many, by the sizes (1 if not named), lead to each node, itself included.

    Nodes are numbered by block and their numbers cut into parts of `bits`. A block and a part are one row: a bit for each
    number and node. Only parts that reach a block are there, and only rows whose bits changed are sent on. What is kept grows
    with the square of the number of nodes (an eighth of a byte for each pair that is in a block and a part met by another), which is what
    exact counts of this kind take; no row for a pair is ever made.
    """
    label = blocks(edges, size)
    made = Blocks(edges, label)
    numbers = written(_numbered(label, sizes))

    def listed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return pd.DataFrame({"block": [key[0]], "first": [pdf["first"].to_numpy(dtype=np.int64).tobytes()], "many": [pdf["size"].to_numpy(dtype=np.int64).tobytes()], "wanted": [pdf.loc[pdf["sends"], "node"].to_numpy(dtype=np.int64).tobytes()]})

    sending = made.sends.select("node").distinct().withColumn("yes", F.lit(True))
    known = numbers.join(sending, "node", "left").select("block", "node", "first", "size", F.coalesce("yes", F.lit(False)).alias("sends"))
    lists = known.groupBy("block").applyInPandas(listed, "block long, first binary, many binary, wanted binary")
    regions = written(made.regions.join(lists, "block"))
    span = numbers.groupBy("block").agg(F.floor(F.min("first") / bits).alias("low"), F.floor((F.max(F.col("first") + F.col("size")) - 1) / bits).alias("high"))
    none = F.lit(None).cast("array<struct<node:bigint,bits:binary>>")
    todo = span.select("block", F.explode(F.sequence("low", "high")).alias("part"), F.lit(None).cast("binary").alias("state"), none.alias("news"))
    state = None
    while True:
        # a row may be large, and rows are few
        rows = todo.join(regions, "block").repartition(F.xxhash64("block", "part"))
        done = written(rows.select("block", "part", "state", "news", "nodes", "guests", "sources", "targets", "first", "many", "wanted").mapInArrow(_spread(bits), _BITS))
        kept = done.select("block", "part", "state", "total")
        old, state = state, written(kept if state is None else kept.union(state.join(kept.select("block", "part"), ["block", "part"], "left_anti")))
        forget(old)
        told = done.select("part", F.explode("sent").alias("x")).select("part", "x.*").join(made.sends, "node")
        news = written(told.groupBy(F.col("to").alias("block"), "part").agg(F.collect_list(F.struct("node", "bits")).alias("news")))
        if news.isEmpty():
            break
        todo = news.join(state.select("block", "part", "state"), ["block", "part"], "left").select("block", "part", "state", "news")
    return state.select(F.explode("total").alias("x")).groupBy(F.col("x.node").alias("node")).agg(F.sum("x.value").alias("value"))
