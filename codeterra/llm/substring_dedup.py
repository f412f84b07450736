"""Exact substring dedup with an FM-index per shard.

Winnowing picks anchors: of every WINDOW - ANCHOR + 1 consecutive ANCHOR-word hashes the smallest, so equal windows of
WINDOW words hold an equal anchor at an equal place. Anchors of two or more documents bring their passages (all windows
around them) together in the shard that the anchor's hash names; equal passages are one there, that of the smallest
doc_id. Each shard builds an FM-index of its passages and streams the passages through it: backward search over the
wavelet matrix gives matching statistics against documents of smaller doc_id, and the intervals of WINDOW words or more.
An anchor with more than SHARD passages (one passage in many surroundings) would be one task's: its windows are settled
by their own hashes instead, with the smallest doc_id of each combined before the shuffle. Nothing here is broadcast: anchors,
passages and places all grow with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.llm import fm_index, textnum
from codeterra.llm.decontaminate import _runs, winnow
from codeterra.llm.lineage import cut, drop_stored, stored

WINDOW = 50
ANCHOR = 25
#: Passages in a shard, about, and of one anchor at most.
SHARD = 4000


def _anchors(words: textnum.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the anchors of texts with at least one window."""
    size = window // 2
    counts = np.where(words.counts >= window, words.counts - size + 1, 0)
    hashes = textnum.gram_hashes(words.hashes, size)
    at = winnow(hashes, words.of[:-1], counts, window - size + 1)
    return at, hashes[at]


def _place(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, words in textnum.word_slices(batch.column(1)):
                where, hashes = _anchors(words, window)
                of = np.searchsorted(words.of, where, side="right") - 1
                begin = np.maximum(where - (window - window // 2), words.of[of])
                end = np.minimum(where + window, words.of[of + 1])
                # the passage's name: its words (as prefix sums of powers), its length and the anchor's place in it
                n = len(words.hashes)
                power = textnum._power(int(textnum._R), n + 1, "r")
                back = textnum._power(textnum._inverse(int(textnum._R)), n + 1, "i")
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words.hashes * power[:n], dtype=np.uint64)))
                name = (sums[end] - sums[begin]) * back[begin]
                name = textnum.mix64(name ^ textnum.mix64((end - begin).astype(np.uint64) * np.uint64(1 << 20) + (where - begin).astype(np.uint64)))
                ids, rows = (batch.column(k).take(pa.array(of + at)) for k in (0, 2))
                yield pa.record_batch(
                    [pa.array(hashes.view(np.int64)), pa.array(name.view(np.int64)), ids, rows, pa.array((begin - words.of[of]).astype(np.int32)), pa.array((end - begin).astype(np.int16))],
                    names=["anchor", "passage", "doc_id", "row", "begin", "size"],
                )

    return run


_PARTS = "doc_id long, row long, anchor long, passage long, words binary, window long, start int"


def _cut_out(window: int):
    """Rows (doc_id, row, text, places) -> the words of each place; of a place without an anchor's name, a row for each window in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, words in textnum.word_slices(batch.column(2)):
                part = batch.slice(at, end - at)
                hashes = textnum.gram_hashes(words.hashes, window)
                docs, anchors, passages, runs, own_docs, windows, starts = [], [], [], [], [], [], []
                for d, places in enumerate(part.column(3).to_pylist()):
                    own = words.hashes[words.of[d] : words.of[d + 1]]
                    for x in places:
                        if x["anchor"] is not None:
                            docs.append(d)
                            anchors.append(x["anchor"])
                            passages.append(x["passage"])
                            runs.append(own[x["begin"] : x["begin"] + x["size"]].tobytes())
                    whole = [np.arange(x["begin"], min(x["begin"] + x["size"], len(own)) - window + 1) for x in places if x["anchor"] is None]
                    if whole:
                        begin = np.unique(np.concatenate(whole))
                        own_docs.append(np.full(len(begin), d, dtype=np.int64))
                        windows.append(hashes[begin + words.of[d]].view(np.int64))
                        starts.append(begin.astype(np.int32))
                n, m = len(docs), sum(map(len, starts))
                join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.empty(0), kind)
                of = pa.concat_arrays([pa.array(docs, pa.int64()), join(own_docs, pa.int64())])
                columns = [
                    part.column(0).take(of),
                    part.column(1).take(of),
                    pa.concat_arrays([pa.array(anchors, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(passages, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(runs, pa.binary()), pa.nulls(m, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), join(windows, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), join(starts, pa.int32())]),
                ]
                yield pa.record_batch(columns, names=["doc_id", "row", "anchor", "passage", "words", "window", "start"])

    return run


_FOUND = "anchor long, passage long, start int, end int"


def _search(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        passages = [np.frombuffer(x, dtype=np.uint64) for x in pdf["words"]]
        docs = pd.factorize(pdf["doc_id"], sort=True)[0].astype(np.int64)
        found = fm_index.matched_windows(fm_index.FMIndex(passages, docs), passages, docs, window)
        rows = [(a, p, s, e) for a, p, runs in zip(pdf["anchor"], pdf["passage"], found) for s, e in runs]
        return pd.DataFrame(rows, columns=["anchor", "passage", "start", "end"]).astype({"anchor": "int64", "passage": "int64", "start": "int32", "end": "int32"})

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counts, removed, kept = [], [], []
            for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = (text or "").encode().split()
                counts.append(len(words))
                keep, last = [], 0
                if runs:
                    runs = np.array([(r["start"], r["end"]) for r in runs])
                    for a, b in _runs(runs[:, 0], runs[:, 1] - runs[:, 0]):
                        keep += words[last:a]
                        last = min(b, len(words))
                keep += words[last:]
                removed.append(len(words) - len(keep))
                kept.append(b" ".join(keep).decode())
            yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row) of docs; row, a hash of the text, tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))


def _beside(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """docs with places(doc_id, row, a list) of the same text: always a merge of two shuffles, as places grow with the documents."""
    return docs.join(places.hint("merge"), ["doc_id", "row"], how)


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row, spans array<struct<start, end>>): word runs covered by windows that also start in a
    document with a smaller doc_id. Documents without such words are not returned; spans may overlap. row is xxhash64(text).

    Texts of fewer than window words, null texts and rows with a null doc_id have no spans and give none to others. Rows of one
    doc_id count as one document, so windows that only they share stay; each of their texts has its own spans. An empty table gives no rows. Other columns of docs are ignored.
    """
    docs = _keyed(docs).where("doc_id is not null")
    every = stored(docs.mapInArrow(_place(window), "anchor long, passage long, doc_id long, row long, begin int, size short"))
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    # an anchor may be in a third of all documents: what meets rows is stored first, so both sides are plain shuffles that can be split
    rows = stored(every.join(cut(shared).hint("merge"), "anchor"))
    drop_stored(every)
    passages = rows.groupBy("anchor", "passage").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("begin", "size", "row"), "doc_id").alias("at"))
    passages = stored(passages)
    many = cut(passages.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    hot = many.where(F.col("n") > shard).select("anchor")
    # one pass over the texts: passages that are searched, and places of hot anchors, without a name
    searched = passages.join(many.where(F.col("n") <= shard).hint("merge"), "anchor").select("doc_id", "at.row", F.struct("anchor", "passage", "at.begin", "at.size").alias("place"))
    nameless = F.struct(F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("passage"), "begin", "size")
    places = searched.union(rows.join(hot, "anchor").where(F.col("size") >= window).select("doc_id", "row", nameless.alias("place")))
    places = cut(places.groupBy("doc_id", "row").agg(F.collect_list("place").alias("places")))
    parts = _beside(docs, places, "inner").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "places")
    parts = stored(parts.mapInArrow(_cut_out(window), _PARTS))
    texts = parts.where("anchor is not null").select("doc_id", "anchor", "passage", "words")
    shards = max(1, texts.count() // shard)
    found = texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_search(window), _FOUND)
    # the passage of the smallest doc_id has what its shard found, all its later copies are covered whole
    first = passages.join(hot, "anchor", "left_anti").select("anchor", "passage", F.col("doc_id").alias("first"))
    own = found.groupBy("anchor", "passage").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    known = stored(first.join(own.hint("merge"), ["anchor", "passage"], "left"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end")))
    runs = F.when(F.col("doc_id") > F.col("first"), F.when(F.col("size") >= window, whole)).otherwise(F.col("runs"))
    runs = F.transform(runs, lambda r: F.struct((F.col("begin") + r["start"]).alias("start"), (F.col("begin") + r["end"]).alias("end")))
    covered = rows.join(known.hint("merge"), ["anchor", "passage"]).select("doc_id", "row", runs.alias("runs")).where("runs is not null")
    windows = parts.where("window is not null").select("window", "doc_id", "row", "start")
    low = cut(windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "low"))
    gone = windows.join(low.hint("merge"), "window").where("doc_id > low").groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", (F.col("start") + window).alias("end"))).alias("runs"))
    spans = cut(covered.union(gone.select("doc_id", "row", "runs")).groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("spans")))
    for x in (rows, passages, parts, known):
        drop_stored(x)
    return spans


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs(doc_id, text): what repeated_spans() finds is taken out.

    kept has the other words, joined by single spaces. Null texts have no words.
    """
    docs = _keyed(docs)
    both = _beside(docs, repeated_spans(docs, window), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept string")
