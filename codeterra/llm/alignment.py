"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Both tokenizations spell the same bytes, so cumulative sums of token lengths are byte offsets, and offsets in both lists
are common cuts; between two of them lies a group. Tokens of a group that overlap are linked. Links come in order of the
first tokens, each with a run of second ones, and are made by repeating indices, not by loops.

A link's pair of ids is counted over all documents. Texts are dealt in blocks of about BLOCK_BYTES; a block brings each
of its pairs once, with a count. Frequent pairs are in every block, so blocks are salted into about the root of
their number: counts are summed by (pair, salt), then by pair, and totals go back the same way, to the salts and from there
to the blocks. No key ever has more than that root of rows, whatever its frequency, and nothing is broadcast. A block's
documents then read their pairs' totals from their own block's table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeterra.llm import packing
from codeterra.llm.lineage import drop_stored, stored
from codeterra.llm.textnum import slices

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
#: Text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Characters that the second tokenizer takes at once, about.
PART = 1 << 16
_SPACE = "▁"

_workers: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = packing.encoder(first)
        self.plain = Tokenizer.from_file(first)
        self.plain.encode_special_tokens = True
        letters = packing._byte_letters()
        entries = {v: k for k, v in self.plain.get_vocab(with_added_tokens=True).items()}
        self.first_bytes = [self._decoded(entries.get(k, ""), letters) for k in range(max(entries) + 1)]
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        #: No piece goes on over a blank that follows a letter, so texts may be cut there.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.sizes = [np.array([len(b) for b in table], dtype=np.int64) for table in (self.first_bytes, self.second_bytes)]
        #: Ids as digits followed by what comes after them: one more id, the other side, or the next group.
        self.digits = [np.array([f"{k}{mark}".encode() for mark in ",|;" for k in range(len(table))], dtype=object) for table in (self.first_bytes, self.second_bytes)]
        self.lengths = [np.array([len(x) for x in table], dtype=np.int64) for table in self.digits]

    @staticmethod
    def _decoded(entry: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def _parts(self, text: str) -> list[str]:
        """The text in parts that are encoded alike alone: each but the first lost the blank that the encoder puts before it."""
        out, at = [], 0
        while self.cuts and len(text) - at > 2 * PART:
            cut = at + PART
            while True:
                cut = text.find(" ", cut)
                if cut < 0 or text[cut - 1] != " ":
                    break
                cut += 1
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of both for each text; none of either where they don't spell a blank and the text."""
        spaced = [" " + t for t in texts]
        special = [any(x in t for x in self.first.special) for t in spaced]
        one = iter(self.first.encode([t for t, s in zip(spaced, special) if not s]))
        first = [np.array(self.plain.encode(t, add_special_tokens=False).ids, dtype=np.int64) if s else next(one)[:-1].astype(np.int64) for t, s in zip(spaced, special)]
        parts = [self._parts(t) for t in texts]
        coded = iter(self.second.encode([x for own in parts for x in own], num_threads=1))
        second = [np.array(next(coded) if len(own) == 1 else [i for _ in own for i in next(coded)], dtype=np.int64) for own in parts]
        want = [t.encode() for t in spaced]
        for ids, table, sizes, lossless in ((first, self.first_bytes, self.sizes[0], self.first.fast), (second, self.second_bytes, self.sizes[1], None)):
            every = np.concatenate(ids)
            ends = np.concatenate(([0], np.cumsum(sizes[every])))[np.cumsum([len(x) for x in ids])]
            # the fast encoder only cuts bytes, so lengths tell
            if np.array_equal(ends, np.cumsum([len(w) for w in want])) and (lossless or b"".join(map(table.__getitem__, every.tolist())) == b"".join(want)):
                continue
            for k, (x, w) in enumerate(zip(ids, want)):
                if b"".join(map(table.__getitem__, x.tolist())) != w:
                    first[k] = second[k] = first[k][:0]
                    want[k] = b""
        for k, text in enumerate(texts):
            if not text:
                first[k] = second[k] = first[k][:0]
        return [first, second]


def pair(first: str, second: str) -> Pair:
    if (first, second) not in _workers:
        _workers[first, second] = Pair(first, second)
    return _workers[first, second]


def aligned(first_sizes: np.ndarray, second_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each first and each second token, and links as (first, second) positions; sizes are the tokens' bytes and have the same sum."""
    ends_a, ends_b = np.cumsum(first_sizes), np.cumsum(second_sizes)
    common = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    low = np.searchsorted(ends_b, ends_a - first_sizes, side="right")
    high = np.searchsorted(ends_b - second_sizes, ends_a, side="left")
    many = high - low
    left = np.repeat(np.arange(len(ends_a)), many)
    right = np.arange(len(left)) + np.repeat(low - (np.cumsum(many) - many), many)
    return group_a, group_b, left, right


def spelled(ids: list[np.ndarray], groups: list[np.ndarray], digits: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; of all groups, and the end of each group's part."""
    marked, sizes = [], []
    for side in (0, 1):
        last = np.append(groups[side][1:] != groups[side][:-1], True)
        at = ids[side] + np.where(last, side + 1, 0) * (len(digits[side]) // 3)
        marked.append(digits[side][at])
        sizes.append(lengths[side][at])
    key = np.concatenate((2 * groups[0], 2 * groups[1] + 1))
    order = np.argsort(key, kind="stable")
    ends = np.cumsum(np.bincount(key >> 1, weights=np.concatenate(sizes))).astype(np.int64)
    return b"".join(np.concatenate(marked)[order].tolist()), ends


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary, counts binary"


def _rows(both: Pair, docs: list, texts: list[str]) -> tuple[list[list], list[np.ndarray]]:
    """A row and the links' pairs of ids for each text. All texts are worked on at once: byte offsets run on over them, and the end of each is a common cut."""
    a, b = both.encode(texts)
    many = np.array([[len(x) for x in a], [len(x) for x in b]])
    a, b = np.concatenate(a), np.concatenate(b)
    group_a, group_b, left, right = aligned(both.sizes[0][a], both.sizes[1][b])
    ends_a = np.cumsum(many[0])
    groups = np.append(group_a, -1)[ends_a - 1] + 1  # up to the end of each text; the last of an empty one is its predecessor's
    groups[ends_a == 0] = 0
    link_ends = np.searchsorted(left, ends_a)
    said, said_ends = spelled([a, b], [group_a, group_b], both.digits, both.lengths)
    said_ends = np.concatenate(([0], said_ends))
    pairs = a[left] << 32 | b[right]
    rows, links, last, link = [], [], 0, 0
    for doc, n_a, n_b, group, end in zip(docs, many[0].tolist(), many[1].tolist(), groups.tolist(), link_ends.tolist()):
        digest = hashlib.sha256(said[said_ends[last] : said_ends[group] - 1]).hexdigest() if n_a else ""
        rows.append([doc, n_a, n_b, group - last, end - link, digest])
        links.append(pairs[link:end])
        last, link = group, end
    return rows, links


def _align(first: str, second: str):
    """Rows (doc_id, text) -> a row for each, with its links as places in its block's table of pairs, and a row with this table for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, block = pair(first, second), TaskContext.get().partitionId() << 32
        rows: list[list] = []
        held, links = 0, []

        def flush() -> pa.RecordBatch:
            place, known = pd.factorize(np.concatenate(links))
            order = np.argsort(known)
            rank = np.empty(len(known), dtype=np.uint16 if len(known) <= 1 << 16 else np.uint32)
            rank[order] = np.arange(len(known))
            counts = np.bincount(place, minlength=len(known))[order]
            place = rank[place]
            for row, part in zip(rows, np.split(place, np.cumsum([len(x) for x in links])[:-1])):
                row.append(part.tobytes())
            columns = [pa.array([block] * (len(rows) + 1), pa.int64())]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            columns += [pa.array([row[k] for row in rows] + [None], kind) for k, kind in enumerate(kinds)]
            columns += [pa.array([None] * len(rows) + [x.tobytes()], pa.binary()) for x in (known[order], counts.astype(np.int64))]
            return pa.record_batch(columns, names=["block", *_DOC, "links", "pairs", "counts"])

        for batch in batches:
            for at, end, data, _ in slices(batch.column(1)):
                part = batch.slice(at, end - at)
                made, found = _rows(both, part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                rows += made
                links += found
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield flush()
                    rows, links, held, block = [], [], 0, block + 1
        if rows:
            yield flush()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pairs, counts) -> a row for each pair."""
    for batch in batches:
        for block, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            known = np.frombuffer(pairs.as_py(), dtype=np.int64)
            yield pa.record_batch([pa.array([block] * len(known), pa.int64()), pa.array(known), pa.array(np.frombuffer(counts.as_py(), dtype=np.int64))], names=["block", "pair", "n"])


def _counted(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
    """A block's documents with what their links' pairs count; totals are the block's pairs, whose order is that of its table."""
    order = np.argsort(totals.column("pair").to_numpy())
    total = totals.column("total").to_numpy()[order]
    best = (total == totals.column("best").to_numpy()[order]).astype(np.int64)
    kind = np.uint16 if len(total) <= 1 << 16 else np.uint32
    n_best, sums = [], []
    for links in docs.column("links"):
        at = np.frombuffer(links.as_py(), dtype=kind)
        sums.append(int(total[at].sum()))
        n_best.append(int(best[at].sum()))
    return docs.select(_DOC[:-1]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, total, best) over all blocks, best being the largest total of the pair's second id; and (block, pair, total, best) for each block's pairs."""
    pairs = blocks.select("block", "pairs", "counts").mapInArrow(_pairs, "block long, pair long, n long")
    salts = max(1, math.isqrt(blocks.count()))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    part = stored(salted.groupBy("pair", "salt").agg(F.sum("n").alias("n")))
    totals = part.groupBy("pair").agg(F.sum("n").alias("total"))
    # the pairs of one second id are as many as there are first ids, at most
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    totals = stored(totals.withColumn("best", F.max("total").over(Window.partitionBy(second))))
    back = part.select("pair", "salt").join(totals.hint("merge"), "pair").hint("merge")
    return totals, salted.select("block", "pair", "salt").join(back, ["pair", "salt"]).select("block", "pair", "total", "best")


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text).

    first is the path of a byte-level BPE (tokenizers' JSON), second that of a piece model; first encodes a blank and the
    text, second the text, which puts the blank before it. Strings of special tokens are plain text. A text that is null
    or empty, or that either tokenizer does not spell byte by byte, has no tokens: zeros and ''. n_best counts the
    links whose pair is as frequent as any of its second id, count_sum adds up the frequencies of all links' pairs.
    Repeated rows count as often as they come. No rows give no rows. Other columns of docs are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(docs.mapInArrow(_align(first, second), _BLOCKS))
    _, known = pair_counts(found.where("pairs is not null"))
    rows = found.where("pairs is null").select("block", *_DOC, "links")
    both = rows.groupBy("block").cogroup(known.groupBy("block"))
    return both.applyInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def links(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(first_id, second_id, count, best) over all of docs(doc_id, text): how often tokens of both vocabularies overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(docs.mapInArrow(_align(first, second), _BLOCKS))
    totals, _ = pair_counts(found.where("pairs is not null"))
    drop_stored(found)
    return totals.select(F.shiftright("pair", 32).alias("first_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("second_id"), F.col("total").alias("count"), (F.col("total") == F.col("best")).alias("best"))
