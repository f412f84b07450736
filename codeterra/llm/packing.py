"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A round serves every queue once, in order of the sources' names; queue
s earns a quantum proportional to its target share, what it cannot yet spend (less than one token) stays as its
deficit, so after r rounds it has been served floor(r * quantum), or all it has. Rounds are as long as a sequence, so
each sequence holds every source at its target proportion, to within the tokens of one deficit. The stream of all
rounds is cut every LENGTH tokens; only the last sequence is not full.

As the number of tokens that any queue has been served after r rounds is known, no round is simulated: a document's
place follows from its place in its queue, which is a sum over the blocks (tasks) before it. Deficits therefore carry
over rounds, sequences and partitions alike, and a hot source is as many blocks as its rows need. Totals by queue are kept
by each task where there are few queues; where there are many, the turns of all queues are sorted by round and queue, and
a turn's place is the sum over those before it. Both give the same places.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeterra.llm.lineage import drop_stored, shuffle_width, stored

LENGTH = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Totals by queue are kept by each task for so many sources at most; beyond, turns are sorted.
MAX_QUEUES = 4096
#: Bytes of table that go to every task.
BROADCAST_BYTES = 32 << 20
#: Fraction bits of a quantum.
FRACTION = 16

# The pattern of byte-level pre-tokenization with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_workers: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids as the tokenizer file gives them, without special tokens added.

    Where the file is a byte-level BPE whose ids are in order of its merges, plain Latin texts take the same vocabulary's
    faster encoder; texts with other characters (whose classes may differ between libraries) or with the string of a
    special token take the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fast = None
        level = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level["add_prefix_space"] and not spec.get("normalizer"):
            letters, vocab = _byte_letters(), spec["model"]["vocab"]
            made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
            plain = {k: v for k, v in vocab.items() if k not in self.special and all(c in letters for c in k)}
            if None not in made and made == sorted(made) and len(plain) == len(made) + 256:
                import tiktoken

                ranks = {bytes(letters[c] for c in k): v for k, v in plain.items()}
                self.fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out, slow = [], []
        for k, text in enumerate(texts):
            text = text or ""
            if self.fast and (text.isascii() or max(text) < "\u0250") and not any(x in text for x in self.special):
                out.append(np.array([*self.fast.encode_ordinary(text), END], dtype=np.uint32))
            else:
                out.append(None)
                slow.append(k)
        if slow:
            for k, got in zip(slow, self.tokenizer.encode_batch_fast([texts[k] or "" for k in slow], add_special_tokens=False)):
                out[k] = np.array([*got.ids, END], dtype=np.uint32)
        return out


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "uint16" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "uint32"


def _tokenize(path: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        served: dict[str, int] = {}
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode(part.column(1).to_pylist())
                queues = part.column(2).to_pylist()
                before = []
                for queue, x in zip(queues, ids):
                    before.append(served.get(queue, 0))
                    served[queue] = before[-1] + len(x)
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array([block] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(width).tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "queue", "block", "before", "n", "ids"],
                )

    return run


class Rounds:
    """Queues with their totals and quanta, and the stream position of any queue's tokens."""

    def __init__(self, totals: dict[str, int], length: int, shares: dict[str, float] | None = None):
        self.names = sorted(totals)
        self.at = {name: k for k, name in enumerate(self.names)}
        self.totals = np.array([totals[name] for name in self.names], dtype=np.int64)
        want = np.array([(shares or totals).get(name, 0) for name in self.names], dtype=np.float64)
        self.quanta = np.maximum(1, np.round(want / max(want.sum(), 1e-9) * (length << FRACTION))).astype(np.int64)
        self.length = length

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue after so many rounds, by round and queue."""
        return np.minimum((rounds[:, None] * self.quanta[None, :]) >> FRACTION, self.totals[None, :])

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        return -((-(token + 1) << FRACTION) // self.quanta[queue])

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the document, length, stream position) of the pieces of documents first:first + n of their queues."""
        low, high = self.round_of(queue, first), self.round_of(queue, first + n - 1)
        many = high - low + 1
        row = np.repeat(np.arange(len(n)), many)
        rounds = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        distinct, which = np.unique(rounds, return_inverse=True)
        begin, done, position = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
        order = np.argsort(which, kind="stable")
        step = max(1, (1 << 20) // len(self.names))
        for a in range(0, len(distinct), step):
            before, after = self.served(distinct[a : a + step] - 1), self.served(distinct[a : a + step])
            turn = np.cumsum(after - before, axis=1) - (after - before)
            x, y = np.searchsorted(which[order], [a, a + step])
            mine = order[x:y]
            r, q = which[mine] - a, queue[row[mine]]
            begin[mine], done[mine] = before[r, q], after[r, q]
            position[mine] = before.sum(axis=1)[r] + turn[r, q] - before[r, q]
        start = np.maximum(begin, first[row])
        stop = np.minimum(done, (first + n)[row])
        some = stop > start
        row, start, stop, position = row[some], start[some], stop[some], position[some]
        return merged(row, start - first[row], stop - start, position + start, self.length)


def merged(row: np.ndarray, start: np.ndarray, size: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of one document without a gap in the stream as one piece; sequences cut it again."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1] + size[:-1])
    head = np.flatnonzero(new)
    size = np.add.reduceat(size, head) if len(head) else head
    row, start, position = row[head], start[head], position[head]
    cuts = (position + size - 1) // length - position // length + 1
    again = np.repeat(np.arange(len(row)), cuts)
    k = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    left = np.maximum(position[again], (position[again] // length + k) * length)
    right = np.minimum((position + size)[again], (position[again] // length + k + 1) * length)
    return row[again], start[again] + left - position[again], right - left, left


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (queue, first, n, quantum) -> the document's tokens by the rounds that serve them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            first, n, quantum = (part.column(k).to_numpy() for k in (1, 2, 3))
            row = np.repeat(np.arange(len(n)), n)
            token = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rounds = -((-(token + 1) << FRACTION) // quantum[row])
            head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (rounds[1:] != rounds[:-1]))))
            size = np.diff(np.append(head, len(row)))
            yield pa.record_batch([part.column(0).take(pa.array(row[head])), pa.array(first[row[head]]), pa.array(token[head]), pa.array(size), pa.array(rounds[head])], names=["queue", "first", "token", "size", "round"])


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> (queue, first, token, size, part, place), place being the sum of sizes before it in this task."""
    from pyspark import TaskContext

    task, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column(3).to_numpy()
        place = done + np.cumsum(size) - size
        done += int(size.sum())
        yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array([task] * len(size), pa.int32()), pa.array(place, pa.int64())], names=["queue", "first", "token", "size", "part", "place"])


def _sorted_turns(placed: DataFrame, totals: DataFrame, length: int, shares: dict[str, float] | None) -> DataFrame:
    """placed with the turns array<struct<token, size, position>> of each document, by a sort of all turns."""
    spark = placed.sparkSession
    want = totals.select("queue", F.col("sum").cast("double").alias("want"))
    if shares:
        named = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "queue string, share double")
        want = totals.join(named, "queue", "left").select("queue", F.coalesce("share", F.lit(0.0)).alias("want"))
    whole = want.agg(F.sum("want")).first()[0] or 0.0
    quanta = want.select("queue", F.greatest(F.lit(1), F.rint(F.col("want") / max(whole, 1e-9) * (length << FRACTION)).cast("long")).alias("quantum"))
    turns = placed.select("queue", "first", "n").join(quanta, "queue").select("queue", "first", "n", "quantum")
    turns = turns.mapInArrow(_turns, "queue string, first long, token long, size long, round long")
    order = ["round", "queue", "token"]
    turns = turns.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    turns = stored(turns.mapInArrow(_before, "queue string, first long, token long, size long, part int, place long"))
    sums = turns.groupBy("part").agg(F.sum("size").alias("sum"))  # a row for each partition
    earlier = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.join(F.broadcast(sums.select("part", earlier.alias("ahead"))), "part")
    own = turns.groupBy("queue", "first").agg(F.array_sort(F.collect_list(F.struct("token", "size", (F.col("ahead") + F.col("place")).alias("position")))).alias("turns"))
    return placed.join(own, ["queue", "first"])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def _place(shared, length: int, width: str, with_ids: bool):
    """Pieces by the shared Rounds, or by each row's own turns where shared is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds: Rounds | None = shared and shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                first, n = part.column(2).to_numpy(), part.column(3).to_numpy()
                if rounds:
                    queue = np.array([rounds.at[x] for x in part.column(1).to_pylist()], dtype=np.int64)
                    row, start, size, position = rounds.pieces(queue, first, n)
                else:
                    turns = part.column(5)
                    row = np.repeat(np.arange(len(n)), turns.value_lengths().to_numpy())
                    token, size, position = (x.to_numpy() for x in turns.flatten().flatten())
                    row, start, size, position = merged(row, token - first[row], size, position, length)
                ids = [memoryview(np.frombuffer(x.as_py(), dtype=width).astype("<u4").tobytes()) for x in part.column(4)]
                cut = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), size.tolist())]
                rows = pa.array(row)
                yield pa.record_batch(
                    [
                        part.column(0).take(rows),
                        pa.array(start),
                        pa.array(size),
                        pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                        pa.array(n[row]),
                        pa.array(position // length),
                        pa.array(position % length),
                        part.column(1).take(rows),
                        pa.array([x.tobytes() for x in cut] if with_ids else [None] * len(cut), pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, shares: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, source) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids, if asked for).

    tokenizer is the path of a tokenizer file, which each worker opens. A document is its ids and then END, so a null
    or empty text is one token. A null source is a queue named "", any other its text. shares are target proportions by source (by default
    each source's part of all tokens, so all queues end together); a queue that ends early leaves its turns to the
    others, a source that shares doesn't name gets the least quantum. Repeated rows are packed as often as they come.
    No rows give no pieces. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    width = _width(tokenizer)
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue"))
    tokens = stored(docs.mapInArrow(_tokenize(tokenizer, width), "doc_id long, queue string, block int, before long, n long, ids binary"))
    blocks = tokens.groupBy("queue", "block").agg(F.sum("n").alias("sum"))
    totals = blocks.groupBy("queue").agg(F.sum("sum").alias("sum"))
    few = totals.limit(MAX_QUEUES + 1).collect()  # at most MAX_QUEUES + 1 rows
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = blocks.select("queue", "block", earlier.alias("base"))
    # a row for each task and source, so tokens need no shuffle while these rows are few bytes
    held = blocks.agg(F.sum(F.octet_length("queue") + 32)).first()[0] or 0
    base = F.broadcast(base) if held <= BROADCAST_BYTES else base
    placed = tokens.join(base, ["queue", "block"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    shared = None
    if len(few) <= MAX_QUEUES:
        shared = spark.sparkContext.broadcast(Rounds({r["queue"]: r["sum"] for r in few}, length, shares))
    else:
        placed = _sorted_turns(placed, totals, length, shares).select("doc_id", "queue", "first", "n", "ids", "turns")
    out = placed.mapInArrow(_place(shared, length, width, with_ids), _PIECES)
    if with_ids:
        return out
    out = stored(out.drop("ids"))
    drop_stored(tokens)
    return out
