"""Stateful operators on request logs: a sliding-log rate limiter, sessions, latest progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Limits by action, as (requests, seconds).
LIMITS = {"analyse": (10, 60), "comprehend": (5, 3600), "ask": (20, 3600), "reading_path": (5, 3600), "login": (10, 300)}


def decide(log: list[int], now: int, limit: int, window: int) -> tuple[bool, list[int], int]:
    """Whether a request at now (microseconds) is allowed, the log after it, and the seconds to wait; denied requests are not recorded."""
    log = [t for t in log if t > now - window]
    if len(log) < limit:
        return True, [*log, now], 0
    return False, log, -(-(window - (now - log[0])) // 1_000_000)


def rate_limit_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """A stream of requests(key, id, ts) -> (key, id, ts, allowed, retry_after); state is at most limit times per key, dropped when the window has passed.

    A row whose column clear, if there is one, is true empties its key's log and is not returned. Rows without a time are left out. A key's rows of one trigger are decided in order of time, so they are held at once: the source's trigger limits bound them.
    Logs end by the clock, so such a query runs on until it is stopped, with the trigger availableNow too.
    """
    window = seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for when, clear in zip(pdf["ts"].astype("datetime64[us]").astype("int64"), pdf["clear"]):
            allowed, log, wait = (None, [], 0) if clear else decide(log, when, limit, window)
            out.append((allowed, wait))
        made = pdf[["key", "id", "ts"]].assign(allowed=[a for a, _ in out], retry_after=[w for _, w in out])
        yield made[~pdf["clear"].astype(bool)].astype({"allowed": bool})
        if log:
            state.update((log,))
            state.setTimeoutDuration(seconds * 1000)
        elif state.exists:
            state.remove()

    schema = requests.select("key", "id", "ts").schema.add("allowed", "boolean").add("retry_after", "long")
    return _with_clear(requests).where("ts is not null").groupBy("key").applyInPandasWithState(fold, schema, "log array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _with_clear(requests: DataFrame) -> DataFrame:
    clear = F.coalesce(F.col("clear"), F.lit(False)) if "clear" in requests.columns else F.lit(False)
    return requests.select("key", "id", "ts", clear.alias("clear"))


def rate_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """The same over a table, (key, id, ts, allowed, retry_after).

    Rows go by key, in order of time, through tasks that hold no more than one key's log of at most limit times, so a hot key's
    rows are streamed and never gathered. Rows without a key are one key's, those without a time are left out. A row
    whose column clear, if there is one, is true empties the key's log and is not returned.
    """
    window = seconds * 1_000_000
    schema = requests.select("key", "id", "ts").schema.add("allowed", "boolean").add("retry_after", "long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = object(), []
        for batch in batches:
            allowed, waits = [], []
            for key, when, clear in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), batch.column(3).to_pylist()):
                if key != last:
                    last, log = key, []
                ok, log, wait = (None, [], None) if clear else decide(log, when, limit, window)
                allowed.append(ok)
                waits.append(wait)
            made = pa.record_batch([*batch.columns[:3], pa.array(allowed, pa.bool_()), pa.array(waits, pa.int64())], names=[*batch.schema.names[:3], "allowed", "retry_after"])
            yield made.filter(made.column(3).is_valid())

    return _with_clear(requests).where("ts is not null").repartition("key").sortWithinPartitions("key", "ts", "id").mapInArrow(fold, schema)


def sessions(requests: DataFrame, gap_seconds: int) -> DataFrame:
    """(key, started, ended, n): runs of requests with no gap of gap_seconds or more."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    before = F.lag("ts").over(order)
    new = F.when(before.isNull() | (F.col("ts") >= before + F.expr(f"interval {gap_seconds} seconds")), 1).otherwise(0)
    runs = requests.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("key", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def latest_status(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key, whole."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("x")).select(key, "x.*")


def still_alive(uses: DataFrame, key: str, ttl: str, now: DataFrame) -> DataFrame:
    """(key, used): keys whose last use is less than ttl before now, a table of one row and column."""
    used = uses.groupBy(key).agg(F.max("ts").alias("used"))
    return used.join(F.broadcast(now.toDF("now"))).where(F.col("used") + F.expr(f"interval {ttl}") > F.col("now")).select(key, "used")  # one row


def throttled(steps: DataFrame, key: str, *order: str, every: int = 5) -> DataFrame:
    """(key, ..., done, total): of each key's steps in order every fifth and the last one."""
    counted = steps.withColumn("done", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy(key)))
    return counted.where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
