"""Time-varying curriculum: which part of which source is trained on when.

Every source has a weight and a schedule, a rate that changes over training (piecewise linear in progress, which runs
from 0 to 1). Weights fix how many words a source gives in all (its target); the schedule's integral, scaled to
the target, is its cumulative demand. A source's documents stand in one order, by a hash of their ids, so each covers a
stretch of its source's words; the inverse of the cumulative demand at the stretch's begin is the document's position
in training. Where the target is more than the source has, the stretch comes again, one source size further. Documents
are then sorted by ranges of position.

Sums before a document are those of the tasks before its own and of its own task, so a hot source is as many sorted
ranges as its rows need; no window gathers a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeterra.llm.lineage import drop_stored, shuffle_width, stored
from codeterra.llm.textnum import BLANK_WORDS, slices

SHARE = 1.5
MOST = 2.0
#: Bytes of table that go to every task.
BROADCAST_BYTES = 32 << 20
KNOTS = "array<struct<at double, rate double>>"
STEADY = ((0.0, 1.0), (1.0, 1.0))


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of anything but ASCII blanks in each text."""
    found = []
    for _, _, data, offsets in slices(texts):
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = BLANK_WORDS[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        before[offsets] = False
        starts = np.concatenate(([0], np.cumsum(inside & ~before)))
        found.append(starts[offsets[1:]] - starts[offsets[:-1]])
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[1:], pa.array(word_counts(batch.column(0)), pa.int64())], names=[*batch.schema.names[1:], "size"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source (key first, size second) -> before: the sizes of the same source's rows before it in this task."""
    from pyspark import TaskContext

    task, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys, size = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        if not len(keys):
            continue
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.cumsum(size) - size
        many = np.diff(np.append(head, len(keys)))
        before = sums - np.repeat(sums[head], many)
        if keys[0] == last:
            before[: many[0]] += held
        last, held = keys[-1], int(before[-1] + size[-1])
        yield pa.record_batch([*batch.columns, pa.array([task] * len(keys), pa.int32()), pa.array(before)], names=[*batch.schema.names, "task", "before"])


def key_of(source: Column) -> Column:
    """A text that sorts sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def ranked(sources: DataFrame) -> DataFrame:
    """sources(key, ...) with rank, from 0 on by key; sorted in ranges, so there is no bound on their number."""
    width = shuffle_width(sources.sparkSession)
    at = stored(sources.repartitionByRange(width, "key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = at.groupBy(task.alias("task")).count()  # a row for each partition
    ahead = counts.select("task", F.coalesce(F.sum("count").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return at.withColumn("task", task).join(F.broadcast(ahead), "task").withColumn("rank", F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("task", "ahead", "at")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source_size, weight, ...) with target: together share of all sizes, in proportion to weight, none above most times its size.

    What a source can't take goes to the others by their weights, until none is above; then each target is the lesser of
    its bound and weight times one level.
    """
    bound = F.col("source_size") * F.lit(most)
    spent = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, full = float("inf"), -1
    wanted = share * (spent["size"] or 0)
    left, weight = wanted, spent["weight"] or 0.0
    while weight:
        level = left / weight
        above = F.col("weight") * level > bound
        row = sources.agg(F.sum(F.when(above, bound)).alias("bound"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("full")).first()
        if row["full"] <= full or not row["full"]:
            break
        full, left, weight = row["full"], wanted - row["bound"], row["weight"] or 0.0
    if not weight:
        level = float("inf")
    return sources.withColumn("target", F.when(F.col("weight") == 0, 0.0).otherwise(F.least(bound, F.col("weight") * F.lit(level))))


def _segments(knots: Column) -> Column:
    """array<struct<at, rate, slope, before, area>>: the pieces of a schedule, with the area before each."""
    pieces = F.transform(
        F.slice(knots, 1, F.size(knots) - 1),
        lambda a, k: F.struct(
            a["at"].alias("at"),
            a["rate"].alias("rate"),
            ((knots[k + 1]["rate"] - a["rate"]) / (knots[k + 1]["at"] - a["at"])).alias("slope"),
            ((a["rate"] + knots[k + 1]["rate"]) / 2 * (knots[k + 1]["at"] - a["at"])).alias("area"),
        ),
    )
    before = lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0.0), lambda s, p: s + p["area"])
    return F.transform(pieces, lambda p, k: F.struct(p["at"].alias("at"), p["rate"].alias("rate"), p["slope"].alias("slope"), before(k).alias("before"), p["area"].alias("area")))


def progress(segments: Column, part: Column) -> Column:
    """The progress at which a schedule has given this part (0 to 1) of its integral."""
    whole = F.element_at(segments, -1)["before"] + F.element_at(segments, -1)["area"]
    area = part * whole

    def solved(s: Column) -> Column:
        rest = area - s["before"]
        return s["at"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (s["rate"] + F.sqrt(F.greatest(s["rate"] * s["rate"] + 2 * s["slope"] * rest, F.lit(0.0)))))

    return solved(F.element_at(F.filter(segments, lambda s: (s["before"] == 0) | (s["before"] <= area)), -1))


def assign(docs: DataFrame, plan, *, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken, passes, position, and the columns of docs named in keep (none of these names).

    plan gets a DataFrame of (key, source, source_size) and returns it with weight (0 or more) and knots, the schedule as
    array<struct<at, rate>> from 0 to 1, rates 0 or more and not all 0. size counts words between ASCII blanks; null and empty texts have none and
    are never taken. passes lists the struct<pass, words, position> of each time that a document is taken; the last document of a
    target is taken in part (its first words), so a source gives exactly its target without its fraction. position is that of the
    first pass, null if there is none. A null source is one more source. Rows with one doc_id stand in the order of
    their sizes, equal rows share what they get in some order. No rows give no rows.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    kept = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)]
    docs = docs.select("text", "doc_id", F.col("source").cast("string").alias("source"), *kept)
    sized = stored(docs.mapInArrow(_sized, docs.drop("text").withColumn("size", F.lit(0).cast("long")).schema))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = plan(sums.select(key_of(F.col("source")).alias("key"), "source", "source_size"))
    planned = stored(planned.select("key", "source_size", F.col("weight").cast("double").alias("weight"), _segments(F.col("knots")).alias("segments")))
    demand = stored(targets(planned, share, most))
    order = ["key", "mark", "size", "row"]
    rows = sized.withColumns({"key": key_of(F.col("source")), "mark": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    rows = rows.select("key", "size", *(c for c in rows.columns if c not in ("key", "size", "mark")))
    rows = stored(rows.mapInArrow(_running, rows.withColumns({"task": F.lit(0), "before": F.lit(0).cast("long")}).schema))
    drop_stored(sized)
    tasks = rows.groupBy("key", "task").agg(F.sum("size").alias("sum"))
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = stored(tasks.select("key", "task", earlier.alias("base")).join(demand, "key"))
    # a row for each task and source
    small = (base.agg(F.sum(F.octet_length("key") + 48 * F.size("segments") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    placed = rows.join(F.broadcast(base) if small else base.hint("merge"), ["key", "task"])
    first = F.col("base") + F.col("before")

    def one(k: Column) -> Column:
        begin = first + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("long")
        at = F.when(words > 0, progress(F.col("segments"), begin / F.nullif(F.col("target"), F.lit(0.0))))
        return F.struct((k + 1).cast("int").alias("pass"), words.alias("words"), at.alias("position"))

    times = F.ceil(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce(times, F.lit(1)), F.lit(1)) - 1), one)
    placed = placed.withColumn("passes", F.filter(every, lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    placed = placed.withColumns({"taken": taken, "position": F.get("passes", F.lit(0))["position"]})
    back = [F.col(f"__{k}").alias(c) for k, c in enumerate(keep)]
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position", "row", *back)


def by_position(assigned: DataFrame) -> DataFrame:
    """assign()'s documents sorted by ranges of their first position; those that are not taken come first."""
    order = ["position", "doc_id", "row"]
    return assigned.repartitionByRange(shuffle_width(assigned.sparkSession), *order).sortWithinPartitions(*order).drop("row")


def curriculum(docs: DataFrame, plan, *, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """The training order: a row for each time that a document is taken (doc_id, source, pass, words, position and what keep names), sorted by position.

    Of a document that is taken in part, words says how many of its first words count. See assign() for plan, nulls and ties.
    """
    found = assign(docs, plan, share=share, most=most, keep=keep)
    found = found.select("doc_id", "source", F.explode("passes").alias("p"), *[F.col(f"`{c}`") for c in keep])
    found = found.select("doc_id", "source", "p.*", *[F.col(f"`{c}`") for c in keep])
    return found.repartitionByRange(shuffle_width(docs.sparkSession), "position", "source", "doc_id").sortWithinPartitions("position", "source", "doc_id")


def cycled(weights: tuple[float, ...], schedules: tuple[tuple[tuple[float, float], ...], ...]):
    """A plan that gives sources, by code point and null last, these weights and schedules in turn."""

    def plan(sources: DataFrame) -> DataFrame:
        found = ranked(sources)
        knots = F.array(*[F.array(*[F.struct(F.lit(a).alias("at"), F.lit(r).alias("rate")) for a, r in s]) for s in schedules])
        turn = lambda n: (F.col("rank") % n + 1).cast("int")
        return found.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), turn(len(weights))), "knots": F.element_at(knots, turn(len(schedules)))})

    return plan
