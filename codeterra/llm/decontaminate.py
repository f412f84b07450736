"""Benchmark decontamination by winnowing.

Of every SPAN - KGRAM + 1 consecutive k-gram hashes the smallest is kept (the rightmost of equal ones), on both sides
alike, so each shared run of SPAN words has a kept k-gram in common. Documents look their fingerprints up in the
benchmark's, and each hit is extended to the left and right, word by word, to the windows it is part of. Items of fewer
than SPAN words are one window each; they are looked up by a k-gram of their own length.

The benchmark's words and fingerprints are broadcast in blocks of about BLOCK_WORDS words (a larger item is in a block
with few others), one at a time: a benchmark of several blocks is as many passes over the same rows, each stored before
the next block is read, so neither the driver nor a task holds more than one. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.llm import textnum
from codeterra.llm.lineage import cut, drop_stored, stored

SPAN = 10
KGRAM = 5
BLOCK_WORDS = 4_000_000

_SCANNED = ["__id", "__text", "n_words", "spans", "item_ids"]


def winnow(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Positions kept of k-gram hashes; each text's k-grams begin at first and are counts many."""
    n = len(hashes)
    if window == 1:
        of = np.repeat(np.arange(len(counts)), counts)
        return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    starts = np.repeat(first, np.maximum(counts - window + 1, 0))
    if not len(starts):
        return starts
    per = np.maximum(counts - window + 1, 0)
    starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
    best, at = hashes[starts], starts.copy()
    for k in range(1, window):
        here = hashes[np.minimum(starts + k, n - 1)]
        less = here <= best
        best = np.where(less, here, best)
        at[less] = starts[less] + k
    return np.unique(at)


class Index:
    """Words and fingerprints of a block of benchmark items."""

    def __init__(self, names: list[str], words: list[np.ndarray]):
        self.names = np.array(names, dtype=object)
        self.words = np.concatenate(words) if words else np.empty(0, dtype=np.uint64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.owner = np.repeat(np.arange(len(words)), sizes)
        #: k -> (sorted hashes, word position of each)
        self.schemes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({KGRAM if n >= SPAN else int(n) for n in sizes.tolist() if n}):
            for whole in (False, True):  # long items, short ones
                mine = (sizes >= SPAN) & (k == KGRAM) if not whole else (sizes == k) & (sizes < SPAN)
                if mine.any():
                    grams = textnum.gram_hashes(self.words, k)
                    at = winnow(grams, self.begins[mine], sizes[mine] - k + 1, 1 if whole else SPAN - KGRAM + 1)
                    order = np.argsort(grams[at], kind="stable")
                    self.schemes[-k if whole else k] = (grams[at][order], at[order])


def _hits(words: textnum.Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word position, length, item) rows of windows that occur, and nothing else, as two arrays: positions with lengths, items."""
    starts, items = [], []
    for scheme, (known, places) in index.schemes.items():
        k, whole = abs(scheme), scheme < 0
        grams = textnum.gram_hashes(words.hashes, k)
        counts = np.maximum(words.counts - k + 1, 0)
        at = winnow(grams, words.of[:-1], counts, 1 if whole else SPAN - KGRAM + 1)
        if not len(at):
            continue
        low = np.searchsorted(known, grams[at], side="left")
        found = np.flatnonzero((low < len(known)) & (known[np.minimum(low, len(known) - 1)] == grams[at]))
        if not len(found):
            continue
        at, low = at[found], low[found]
        many = np.searchsorted(known, grams[at], side="right") - low
        p = np.repeat(at, many)
        q = places[np.repeat(low, many) + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)]
        if whole:
            starts.append(np.stack((p, np.full(len(p), k)), axis=1))
            items.append(index.owner[q])
            continue
        reach = SPAN - KGRAM
        of = np.searchsorted(words.of, p, side="right") - 1
        item = index.owner[q]
        equal = np.zeros((len(p), KGRAM + 2 * reach), dtype=bool)
        for c, d in enumerate(range(-reach, KGRAM + reach)):
            ok = (p + d >= words.of[of]) & (p + d < words.of[of + 1]) & (q + d >= index.begins[item]) & (q + d < index.ends[item])
            equal[ok, c] = words.hashes[p[ok] + d] == index.words[q[ok] + d]
        for c in range(reach + 1):
            good = equal[:, c : c + SPAN].all(axis=1)
            starts.append(np.stack((p[good] - reach + c, np.full(int(good.sum()), SPAN)), axis=1))
            items.append(item[good])
    if not starts:
        return np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(items)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of [start, start + length) as disjoint runs."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, n in zip(starts[order].tolist(), lengths[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def _scan(index):
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            for at, end, words in textnum.word_slices(batch.column(1), textnum.PLAIN_WORDS, lower=True):
                part = batch.slice(at, end - at)
                spans = part.column(3).to_pylist()
                items = part.column(4).to_pylist()
                windows, found = _hits(words, block)
                of = np.searchsorted(words.of, windows[:, 0], side="right") - 1
                for d in np.unique(of).tolist():
                    mine = of == d
                    old = [(x["start"], x["end"]) for x in spans[d]]
                    new = windows[mine] - np.array([words.of[d], 0])
                    both = np.array(old + [(a, a + n) for a, n in new.tolist()])
                    spans[d] = [{"start": a, "end": b} for a, b in _runs(both[:, 0], both[:, 1] - both[:, 0])]
                    items[d] = sorted({*items[d], *block.names[np.unique(found[mine])].tolist()} - {None})
                yield pa.record_batch([part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array(spans, struct), pa.array(items, pa.list_(pa.string())), *part.columns[5:]], names=[*_SCANNED, *part.schema.names[5:]])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, words in textnum.word_slices(batch.column(1), textnum.PLAIN_WORDS, lower=True):
            runs = [words.hashes[a:b].tobytes() for a, b in zip(words.of[:-1], words.of[1:])]
            yield pa.record_batch([batch.column(0).slice(at, end - at), pa.array(words.counts, pa.int64()), pa.array(runs, pa.binary())], names=["name", "n", "words"])


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text) and benchmark(item_id, text) -> all columns of docs and n_words, n_hit, spans, item_ids, a row for each row of docs.

    spans are disjoint runs [start, end) of hit words, n_hit their total length, item_ids the sorted distinct ids (as
    text) of items with an occurring window. Null texts have no words; an item without words never occurs; an item
    without an id hits and is not listed; repeated items count once. An empty benchmark gives no hits, an empty docs no rows. Columns
    of docs with the names of new ones are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text")
    items = cut(items.mapInArrow(_item_words, "name string, n long, words binary").where("n > 0").distinct())
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_hit", "spans", "item_ids")]
    carried = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(rest)]
    out = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("item_ids"), *carried)
    passed = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == k).collect()  # about BLOCK_WORDS words
        shared = spark.sparkContext.broadcast(Index([r["name"] for r in rows], [np.frombuffer(r["words"], dtype=np.uint64) for r in rows]))
        out = out.mapInArrow(_scan(shared), out.schema)
        if k + 1 < blocks:
            out = stored(out)
            shared.destroy()
            if passed is not None:
                drop_stored(passed)
            passed = out
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    back = {"doc_id": "__id", "text": "__text"} | {c: f"__{k}" for k, c in enumerate(rest)}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns if c in back], "n_words", hit.alias("n_hit"), "spans", "item_ids")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, item_ids) of flagged()."""
    return flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).drop("text")
