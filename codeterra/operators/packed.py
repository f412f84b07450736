"""Operators on connected components that are too large for lists and small enough for arrays: a sorted array of edges, 8 bytes for each.

Spark numbers a component's nodes from 0 on and makes each edge one long. One task then walks the component, at any depth. Reach, whose
work is that of nodes times edges, is planned by one task (nodes in an order in which what leads to a node comes before it, by level and
then by how many edges lead there) and counted by many: each has the plan, 4 bytes an edge, and the bits of its own part of the nodes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeterra.session import written

#: Buckets in which nodes are numbered.
BUCKETS = 256
#: Bits of reach that a task holds at a time: 128 MB.
BITS = 1 << 30
#: Bits of a row at least.
WIDTH = 256
#: Nodes times edges whose reach one task counts, about, unless there would be more tasks than 3 for each core.
WORK = 4 * 10**11
#: Bytes of rows that are made together, so that they stay in a processor's cache.
CACHE = 1 << 19
#: Numbers in a row of a plan.
CHUNK = 1 << 20
#: Nodes of a level with as many edges that are left are taken together, fewer one by one.
FEW = 16


class Packed(NamedTuple):
    """keys(comp, key), key being an edge's ends, the one that is sorted by in the upper half; ids(comp, id, node); edges and nodes by comp."""

    keys: DataFrame
    ids: DataFrame
    edges: list[int]
    nodes: list[int]


def pack(edges: DataFrame, upward: bool = False) -> Packed:
    """edges(src, dst, low), each once and without loops; low is their component. Sorted by src, or upward by dst."""
    every = written(edges.select("low", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(BUCKETS))))
    sums = written(every.groupBy("low", "bucket").agg(F.count("*").alias("own")))  # BUCKETS rows a component
    comps = written(edges.groupBy("low").agg(F.count("*").alias("n")).join(sums.groupBy("low").agg(F.sum("own").alias("nodes")), "low").withColumn("comp", F.row_number().over(Window.orderBy("low")) - 1))  # a row for each component of those that are large
    ahead = sums.join(F.broadcast(comps), "low").select("low", "bucket", "comp", (F.sum("own").over(Window.partitionBy("low").orderBy("bucket")) - F.col("own")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("low", "bucket").orderBy("node")) - 1
    ids = written(every.withColumn("place", place).join(ahead, ["low", "bucket"]).select("comp", (F.col("ahead") + F.col("place")).alias("id"), "node"))
    found = comps.orderBy("comp").select("n", "nodes").collect()
    to = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"), *(["comp"] if c == "src" else []))
    high, below = ("dst_id", "src_id") if upward else ("src_id", "dst_id")
    keys = edges.select("src", "dst").join(to("src"), "src").join(to("dst"), "dst").select("comp", F.shiftleft(high, 32).bitwiseOR(F.col(below)).alias("key"))
    return Packed(keys, ids, [r["n"] for r in found], [r["nodes"] for r in found])


def solved(packed: Packed, solve: Callable[[np.ndarray, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What solve(keys, nodes) gives for each component, by a task for each."""
    edges, nodes = packed.edges, packed.nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, comp = np.empty(0, dtype=np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                comp = batch.column(0)[0].as_py()
                keys = keys if at else np.empty(edges[comp], dtype=np.int64)
                keys[at : at + batch.num_rows] = batch.column(1).to_numpy()
                at += batch.num_rows
        if at:
            for made in solve(keys, nodes[comp]):
                yield pa.record_batch([pa.array(np.full(made.num_rows, comp, dtype=np.int32)), *made.columns], names=["comp", *made.schema.names])

    return packed.keys.select("comp", "key").repartitionById(len(edges), "comp").mapInArrow(run, f"comp int, {schema}")


def _sorted(keys: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's edges begin, and the other ends of all edges."""
    keys.sort()
    starts = np.searchsorted(keys, np.arange(nodes + 1, dtype=np.int64) << 32)
    return starts, keys.view(np.int32)[::2].copy()


def _times(ends: np.ndarray, nodes: int) -> np.ndarray:
    found = np.zeros(nodes, dtype=np.int64)
    for at in range(0, len(ends), 1 << 22):
        found += np.bincount(ends[at : at + (1 << 22)], minlength=nodes)
    return found


def _of(starts: np.ndarray, ends: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The other ends of some nodes' edges."""
    begin = starts[some]
    many = starts[some + 1] - begin
    upto = np.cumsum(many)
    return ends[np.repeat(begin - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]


def layers(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each node the number of edges of the longest path that leads to it; -1 in cycles and where one leads."""
    nodes = len(starts) - 1
    wait, level = _times(ends, nodes), np.full(nodes, -1, dtype=np.int64)
    front, depth = np.flatnonzero(wait == 0), 0
    while len(front):
        level[front] = depth
        after = []
        for at in range(0, len(front), 1 << 18):
            hit = _of(starts, ends, front[at : at + (1 << 18)])
            np.subtract.at(wait, hit, 1)
            after.append(hit[wait[hit] == 0])
        front, depth = np.unique(np.concatenate(after)), depth + 1
    return level


def strong(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each node the number of its strongly connected component, by one depth-first walk; numbers count from 0, and a component comes after all that it can reach."""
    nodes = len(starts) - 1
    never, gone = -1, nodes + 1
    order, low, at = array("i", [never]) * nodes, array("i", [0]) * nodes, array("q", starts[:-1].tobytes())
    begin, end, to = memoryview(at), memoryview(starts[1:]), memoryview(ends)
    name, stack, path, n, found = array("i", [0]) * nodes, [], [], 0, 0
    for root in range(nodes):
        if order[root] != never:
            continue
        path.append(root)
        stack.append(root)
        order[root] = low[root] = n
        n += 1
        while path:
            node = path[-1]
            k, last, least = begin[node], end[node], low[node]
            while k < last:
                other = to[k]
                k += 1
                seen = order[other]
                if seen == never:
                    path.append(other)
                    stack.append(other)
                    order[other] = low[other] = n
                    n += 1
                    break
                if seen < least:
                    least = seen
            else:
                path.pop()
                if least == order[node]:
                    while True:
                        other = stack.pop()
                        order[other], name[other] = gone, found
                        if other == node:
                            break
                    found += 1
                elif path and least < low[path[-1]]:
                    low[path[-1]] = least
            begin[node], low[node] = k, least
    return np.frombuffer(name, dtype=np.int32)


def _level_rows(keys: np.ndarray, nodes: int) -> Iterator[pa.RecordBatch]:
    yield from _numbers(layers(*_sorted(keys, nodes)), "level")


def _numbers(values: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """Values by their places, as rows."""
    for at in range(0, len(values), CHUNK):
        some = values[at : at + CHUNK]
        yield pa.record_batch([pa.array(np.arange(at, at + len(some))), pa.array(some.astype(np.int64))], names=["id", name])


def levels(edges: DataFrame) -> DataFrame:
    """edges(src, dst, low) -> (node, level): the number of edges of the longest path from a node; null for nodes in cycles and those that lead to one."""
    packed = pack(edges, upward=True)
    found = solved(packed, _level_rows, "id long, level long")
    return found.join(packed.ids, ["comp", "id"]).select("node", F.when(F.col("level") >= 0, F.col("level")).alias("level"))


def _strong_rows(keys: np.ndarray, nodes: int) -> Iterator[pa.RecordBatch]:
    yield from _numbers(strong(*_sorted(keys, nodes)), "name")


def cycles(edges: DataFrame) -> DataFrame:
    """edges(src, dst, low) -> (node, cycle) of strongly connected components of two nodes or more; cycle is the smallest node."""
    packed = pack(edges)
    found = written(solved(packed, _strong_rows, "id long, name long").join(packed.ids, ["comp", "id"]).select("comp", "name", "node"))
    first = found.groupBy("comp", "name").agg(F.min("node").alias("cycle"), F.count("*").alias("size")).where("size > 1")
    return found.join(first, ["comp", "name"]).select("node", "cycle")


_PLAN = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("data", pa.binary())])
_SOURCES, _DEGREES, _SIZES, _LEVELS, _PLACES = range(5)


def _planned(keys: np.ndarray, nodes: int) -> Iterator[pa.RecordBatch]:
    """Keys by src -> for nodes in an order in which what leads to one comes before it: whence edges come, how many each has, for how many nodes it stands, where levels begin, and each old node's place."""
    starts, ends = _sorted(keys, nodes)
    level, name, sizes = layers(starts, ends), np.arange(nodes), np.ones(nodes, dtype=np.int64)
    if (level < 0).any():
        name = strong(starts, ends).astype(np.int64)
        sizes = np.bincount(name)
        nodes = len(sizes)
        for at in range(0, len(keys), CHUNK):
            some = keys[at : at + CHUNK]
            keys[at : at + CHUNK] = name[some >> 32] << 32 | name[some & 0xFFFFFFFF]
        keys.sort()
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1])) & (keys >> 32 != keys & 0xFFFFFFFF)]
        starts, ends = _sorted(keys, nodes)
        level = layers(starts, ends)
    degree = _times(ends, nodes)
    order = np.lexsort((-degree, level))
    place = np.empty(nodes, dtype=np.int64)
    place[order] = np.arange(nodes)
    for at in range(0, len(keys), CHUNK):
        some = keys[at : at + CHUNK]
        keys[at : at + CHUNK] = place[some & 0xFFFFFFFF] << 32 | place[some >> 32]
    _, sources = _sorted(keys, nodes)
    begins = np.searchsorted(level[order], np.arange(level.max() + 2))
    for kind, values in ((_SOURCES, sources), (_DEGREES, degree[order]), (_SIZES, sizes[order]), (_LEVELS, begins), (_PLACES, place[name])):
        for at in range(0, len(values), CHUNK):
            yield pa.RecordBatch.from_pylist([{"kind": kind, "place": at, "data": values[at : at + CHUNK].astype(np.int32).tobytes()}], schema=_PLAN)


class Plan:
    """What one task needs to count reach: groups of rows that no row of the same group leads to, and whence each has its bits."""

    def __init__(self, sources: np.ndarray, degree: np.ndarray, sizes: np.ndarray, begins: np.ndarray):
        self.upto = np.cumsum(sizes, dtype=np.int64)
        self.sizes, self.nodes, self.sum = sizes, len(sizes), int(sizes.sum(dtype=np.int64))
        self.width = min(max(WIDTH, BITS // self.nodes // 64 * 64), -(-self.sum // 64) * 64)
        most = max(FEW, CACHE // (self.width // 8))
        starts = np.concatenate(([0], np.cumsum(degree, dtype=np.int64)))
        self.groups = []
        for low, high in zip(begins[:-1].tolist(), begins[1:].tolist()):
            for first in range(low, high, most):
                last = min(first + most, high)
                begin, many = starts[first:last], degree[first:last]
                # rows of a level are sorted by their number of edges, those with most first
                fewest = np.searchsorted(-many, -np.arange(int(many[0]) + 1), side="left").tolist()
                taken = next((j for j, n in enumerate(fewest) if n < FEW), len(fewest))
                together = [sources[begin[: fewest[j]] + j] for j in range(taken)]
                alone = [(first + k, sources[begin[k] + taken : begin[k] + many[k]]) for k in range(fewest[taken] if taken < len(fewest) else 0)]
                self.groups.append((first, last, together, alone))
        self.firsts = np.array([g[0] for g in self.groups])

    def count(self, part: int, parts: int) -> np.ndarray:
        """For each row how many of the nodes of every parts-th slice lead to it, itself included."""
        words = self.width // 64
        grid, held = np.zeros((self.nodes, words), dtype=np.uint64), np.empty((max(CACHE // (words * 8), FEW), words), dtype=np.uint64)
        found, clean = np.zeros(self.nodes, dtype=np.int64), 0
        for x in range(part * self.width, self.sum, parts * self.width):
            first, last = np.searchsorted(self.upto, x, side="right"), np.searchsorted(self.upto, min(x + self.width, self.sum), side="left") + 1
            at = np.searchsorted(self.firsts, first, side="right") - 1
            # nothing of this slice leads to what comes before its first row
            grid[clean : self.groups[at][0]] = 0
            clean = self.groups[at][0]
            for low, high, together, alone in self.groups[at:]:
                done = len(together[0]) if together else 0
                if done:
                    np.take(grid, together[0], axis=0, out=grid[low : low + done], mode="clip")
                grid[low + done : high] = 0
                for whence in together[1:]:
                    n = len(whence)
                    rows = grid[low : low + n]
                    np.take(grid, whence, axis=0, out=held[:n], mode="clip")
                    np.bitwise_or(rows, held[:n], out=rows)
                for row, whence in alone:
                    for k in range(0, len(whence), len(held)):
                        grid[row] |= np.bitwise_or.reduce(grid[whence[k : k + len(held)]], axis=0)
                if low < last and first < high:
                    self._own(grid, max(low, first), min(high, last), x)
                found[low:high] += np.bitwise_count(grid[low:high]).sum(axis=1, dtype=np.uint32)
        return found

    def _own(self, grid: np.ndarray, low: int, high: int, x: int) -> None:
        """Rows' own bits, as far as they are in the slice that begins with x."""
        right = np.minimum(self.upto[low:high] - x, self.width)
        left = np.maximum(self.upto[low:high] - self.sizes[low:high] - x, 0)
        one = np.flatnonzero(right - left == 1)
        grid[low + one, left[one] >> 6] |= np.uint64(1) << (left[one] & 63).astype(np.uint64)
        for k in np.flatnonzero(right - left > 1).tolist():
            own = np.zeros(self.width, dtype=np.uint8)
            own[left[k] : right[k]] = 1
            grid[low + k] |= np.packbits(own, bitorder="little").view(np.uint64)


def _together(rows: list[tuple[int, int, bytes]], kind: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(data, dtype=np.int32) for _, _, data in sorted(r for r in rows if r[0] == kind)] or [np.empty(0, dtype=np.int32)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One component's plan -> its counts by one part, in rows of many."""
    rows, head = [], None
    for batch in batches:
        if batch.num_rows:
            head = [batch.column(c)[0].as_py() for c in (0, 1, 2)]
            rows += zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)))
    if head:
        parts = [_together(rows, kind) for kind in (_SOURCES, _DEGREES, _SIZES, _LEVELS)]
        rows.clear()
        found = Plan(*parts).count(*head[1:])
        for at in range(0, len(found), CHUNK):
            yield pa.record_batch([pa.array([head[0]], pa.int32()), pa.array([at], pa.int64()), pa.array([found[at : at + CHUNK].astype(np.int32).tobytes()])], names=["comp", "place", "data"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """Rows of a chunk by part -> its sums."""
    total = 0
    for data in table.column("data"):
        total = total + np.frombuffer(data.as_buffer(), dtype=np.int32).astype(np.int64)
    at = key[1].as_py()
    return pa.table({"comp": pa.array(np.full(len(total), key[0].as_py(), dtype=np.int32)), "place": pa.array(np.arange(at, at + len(total))), "blast": pa.array(total)})


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for comp, at, data in zip(*(batch.column(c) for c in range(3))):
            values = np.frombuffer(data.as_buffer(), dtype=np.int32).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(values), comp.as_py(), dtype=np.int32)), pa.array(np.arange(at.as_py(), at.as_py() + len(values))), pa.array(values)], names=["comp", "id", "place"])


def reach(edges: DataFrame) -> DataFrame:
    """edges(src, dst, low) -> (node, blast): how many nodes lead to each, itself included."""
    packed = pack(edges)
    plan = written(solved(packed, _planned, "kind int, place long, data binary"))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    parts = [max(1, min(3 * cores, n * nodes // WORK)) for n, nodes in zip(packed.edges, packed.nodes)]
    first = [sum(parts[:k]) for k in range(len(parts))]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("comp") + 1)
    dealt = plan.where(F.col("kind") < _PLACES).withColumn("parts", of(parts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("comp", "part", "parts", (of(first) + F.col("part")).cast("int").alias("task"), "kind", "place", "data").repartitionById(sum(parts), "task")
    counts = written(dealt.mapInArrow(_counted, "comp int, place long, data binary"))
    sums = counts.groupBy("comp", "place").applyInArrow(_summed, "comp int, place long, blast long")
    places = plan.where(F.col("kind") == _PLACES).select("comp", "place", "data").mapInArrow(_placed, "comp int, id long, place long")
    return places.join(sums, ["comp", "place"]).join(packed.ids, ["comp", "id"]).select("node", "blast")
