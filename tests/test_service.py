"""What stays true when writers, readers, models and limits meet: replaced analyses, compacted logs, calls that are tried again."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from codeterra import store
from codeterra.operators import comprehension
from codeterra.streaming import limits
from tests.conftest import frame, run_until


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/store")


def header(spark, n=1):
    return frame(spark, [("h", "o", "n", "done", n)], "host string, owner string, name string, status string, created_at int")


def files(spark, *paths):
    return frame(spark, [(p, 1) for p in paths], "path string, loc int")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_a_replaced_analysis_is_seen_whole(spark, kept):
    kept.replace_analysis("1", {"files": files(spark, "a", "b"), "edges": files(spark, "e")}, header(spark))
    before = kept.of("files", "1")  # a reader that began before
    kept.replace_analysis("1", {"files": files(spark, "c"), "edges": files(spark).limit(0)}, header(spark, 2))
    assert paths(before) == ["a", "b"] and paths(kept.of("files", "1")) == ["c"] and paths(kept.read("files")) == ["c"]
    assert kept.of("edges", "1").count() == 0 and kept.read("analyses").first()["created_at"] == 2 and kept.of("analyses", "1").count() == 1
    # a writer that ends before its header is never seen
    broken = files(spark, "half").withColumn("loc", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        kept.replace_analysis("1", {"files": files(spark, "new"), "edges": broken}, header(spark, 3))
    assert paths(kept.of("files", "1")) == ["c"] and kept.of("edges", "1").count() == 0
    # tables that are not given stay; others' rows are not touched
    kept.replace_analysis("2", {"files": files(spark, "z")}, header(spark))
    kept.replace_analysis("1", {"edges": files(spark, "e2")}, header(spark, 4))
    kept.prune("1")
    assert paths(kept.of("files", "1")) == ["c"] and paths(kept.of("edges", "1")) == ["e2"] and paths(kept.read("files")) == ["c", "z"]
    assert kept._scan("files").count() == 2 and kept.of("symbols", "1") is None and kept.of("files", "none").count() == 0


def test_compaction_keeps_what_is_appended_meanwhile(spark, kept):
    row = lambda key, text, version: kept.upsert("summaries", frame(spark, [("c", "file", key, text)], "comprehension_id string, scope string, key string, headline string"), F.lit(version))
    row("a", "old", 1)
    row("a", "new", 2)
    row("b", "one", 1)
    listed = store.latest
    try:
        store.latest = lambda *args: row("c", "meanwhile", 1) or listed(*args)
        kept.compact("summaries")
    finally:
        store.latest = listed
    assert {(r["key"], r["headline"]) for r in kept.current("summaries").collect()} == {("a", "new"), ("b", "one"), ("c", "meanwhile")}
    assert kept.read("summaries").count() == 3
    for version, percent in enumerate((1, 2, 3)):
        kept.progress("j", version, percent=percent, status="running" if version == 0 else None)
    kept.compact("jobs")
    kept.finish("j", 9)
    assert kept.read("jobs").count() == 2 and tuple(kept.jobs().select("status", "percent").first()) == ("done", 100)


def test_calls_are_tried_again():
    waits, left = [], [comprehension.error_of(429, "slow down", 99.0), comprehension.error_of(503, "down"), comprehension.BusyError("no route", 2.5)]

    def ask(prompt):
        if left:
            raise left.pop(0)
        return prompt + "!"

    assert comprehension.tried(ask, "x", sleep=waits.append) == "x!" and waits == [30.0, 2.0, 2.5]
    left += [comprehension.BusyError("busy")] * 4
    with pytest.raises(comprehension.BusyError):
        comprehension.tried(ask, "x", sleep=waits.append)
    assert waits[3:] == [1.0, 2.0, 4.0] and left == []
    assert isinstance(comprehension.error_of(401, ""), comprehension.FatalError) and type(comprehension.error_of(400, "")) is RuntimeError


def test_replies_are_asked_once_and_kept(spark, tmp_path):
    log = str(tmp_path / "log")

    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad" and not os.path.exists(log + ".mended"):
            raise RuntimeError("no")
        return prompt.upper()

    prompts = frame(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id int, prompt string")
    folder = f"file://{tmp_path}/kept"
    want = {(1, "A", None), (2, "B", None), (3, "A", None), (4, None, None), (5, None, "no")}
    assert {tuple(r) for r in comprehension.replies(prompts, ask, first_wait=0).collect()} == want
    for _ in range(2):
        assert {tuple(r) for r in comprehension.replies(prompts, ask, kept=folder, wave=1).collect()} == want
    asked = sorted(open(log).read().split())
    assert asked == ["a", "a", "b", "b", "bad", "bad", "bad"]  # twice without and with a store; then only what failed
    open(log + ".mended", "w").close()
    assert (5, "BAD", None) in {tuple(r) for r in comprehension.replies(prompts, ask, kept=folder).collect()}
    assert comprehension.replies(prompts.limit(0), ask, kept=folder).count() == 0

    def refuse(prompt):
        raise comprehension.error_of(403, "bad key")

    with pytest.raises(Exception, match="bad key"):
        comprehension.replies(prompts, refuse).count()


def test_a_cleared_log_counts_anew(spark):
    events = [("k", 1, 0, False), ("k", 2, 1, False), ("k", 3, 2, False), ("k", 4, 3, True), ("k", 5, 4, None), ("other", 6, 5, True), ("other", 7, 6, False)]
    rows = frame(spark, events, "key string, id int, s int, clear boolean").select("key", "id", F.timestamp_seconds("s").alias("ts"), "clear")
    want = {(1, True), (2, True), (3, False), (5, True), (7, True)}
    assert {(r["id"], r["allowed"]) for r in limits.rate_limit(rows, 2, 5).collect()} == want


def test_a_tail_ends_with_its_job(spark, kept):
    kept.progress("j", 1, status="running", percent=5)
    kept.progress("j", 2, stage="parse", percent=20)
    kept.progress("other", 1, status="done", percent=100)
    seen = []
    going = threading.Thread(target=lambda: seen.append(kept.tail("j", lambda step: seen.append((step["version"], step["status"], step["percent"])), 90)))
    going.start()
    while not seen:  # the state as it stands
        time.sleep(0.1)
    kept.progress("other", 2, status="failed")
    kept.progress("j", 4, percent=60)
    kept.compact("jobs")  # the log's files change below the tail
    kept.progress("j", 5, percent=80)
    kept.finish("j", 6)
    going.join(100)
    assert seen[0] == (2, "running", 20) and seen[-2:] == [(6, "done", 100), True]
    versions = [x[0] for x in seen[:-1]]
    assert versions == sorted(set(versions)) and {4, 5, 6} <= set(versions)
    # whoever comes later gets the end alone, whoever lost a tail the state of then; nobody waits for a job that isn't there
    late = []
    assert kept.tail("j", lambda step: late.append((step["version"], step["status"]))) is True and late == [(6, "done")]
    kept.progress("slow", 1, status="running")
    assert kept.tail("slow", lambda step: None, 3) is False and kept.tail("nobody", lambda step: None) is None


def test_a_streams_log_is_cleared(spark, tmp_path):
    at = [(k, f"2024-01-01 00:00:{k:02d}", k == 3) for k in range(6)]
    rows = frame(spark, at, "id long, at string, clear boolean").select(F.lit("k").alias("key"), "id", F.to_timestamp("at").alias("ts"), "clear")
    decided = lambda df: sorted((r["id"], r["allowed"], r["retry_after"]) for r in df.collect())
    for n, part in enumerate((rows.where("id < 3"), rows.where("id >= 3"))):  # the log is kept, then cleared, over two batches
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = limits.rate_limit_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 1, 60)
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").start()
        run_until(run, lambda: any(p["numInputRows"] for p in run.recentProgress))
    got = decided(spark.read.parquet(f"{tmp_path}/out"))
    assert got == decided(limits.rate_limit(rows, 1, 60)) and [x[:2] for x in got] == [(0, True), (1, False), (2, False), (4, True), (5, False)]
