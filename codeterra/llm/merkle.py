"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A paragraph is a line. A section ends with a blank line, or with a paragraph whose hash says so, so that an edit moves
no later boundary. A paragraph's leaves are runs of words that end with a sentence or where a word's hash says so. Every
node's hash is that of its children's hashes, so equal roots mean equal texts. A fingerprint lists the root and, by
section and paragraph, the hashes of all nodes, cut short below the root. Two fingerprints are compared by descent:
sections with equal hashes are passed over whole, then paragraphs of the others, and only leaves of differing paragraphs
are looked at. The branches that differ locate an edit; the likeness is the part of leaves that both share.

Each text is compared with an edited one that ends with the next document's beginning, so texts must meet their
neighbours by doc_id: one shuffle deals rows to ranges of ids, and each range gets one guest row, the neighbour below it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.llm import textnum
from codeterra.llm.lineage import shuffle_width

#: A word's hash ends a leaf one time in so many, a paragraph's a section.
LEAF_WORDS = 6
SECTION_PARAGRAPHS = 4
#: Hex digits of a leaf and of an inner node in a fingerprint.
LEAF_HEX, NODE_HEX = 8, 12
_ENDS = np.isin(np.arange(256), list(b".!?"))
Paragraph = tuple[bytes, list[bytes]]  # hash, leaves
Section = tuple[bytes, list[Paragraph]]


def _hash(parts: list[bytes], level: bytes, size: int = 16) -> bytes:
    return blake2b(b"".join(parts), digest_size=size, person=level).digest()


def _paragraphs(text: bytes) -> list[list[bytes]]:
    """The leaves' bytes of each paragraph; joined, the paragraph with its line's end."""
    offsets = np.array([0, len(text)], dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8)
    words = textnum.Words(data, offsets, textnum.BLANK_WORDS, lower=False)
    cut = (words.hashes % np.uint64(LEAF_WORDS) == 0) | _ENDS[data[words.ends - 1]] if len(words.ends) else np.empty(0, dtype=bool)
    lines = np.flatnonzero(data == 10) + 1
    ends = np.unique(np.concatenate((words.ends[cut], lines, [len(text)])))
    is_line = np.isin(ends, lines)
    out: list[list[bytes]] = [[]]
    at = 0
    for end, line in zip(ends.tolist(), is_line.tolist()):
        if end > at:
            out[-1].append(text[at:end])
        at = end
        if line:
            out.append([])
    return [p for p in out if p]


class Fingerprint:
    """root (hex) and sections of paragraphs of leaves, each node with its short hash."""

    def __init__(self, root: str, sections: list[Section]):
        self.root, self.sections = root, sections

    @classmethod
    def of(cls, text: str) -> "Fingerprint":
        sections: list[Section] = []
        roots, now, hashes = [], [], []

        def close() -> None:
            roots.append(_hash(hashes, b"section"))
            sections.append((roots[-1][: NODE_HEX // 2], now))

        for leaves in _paragraphs(text.encode(errors="surrogatepass")):
            own = [_hash([x], b"leaf") for x in leaves]
            hashes.append(_hash(own, b"paragraph"))
            now.append((hashes[-1][: NODE_HEX // 2], [x[: LEAF_HEX // 2] for x in own]))
            if leaves == [b"\n"] or hashes[-1][0] % SECTION_PARAGRAPHS == 0:
                close()
                now, hashes = [], []
        if now:
            close()
        return cls(_hash(roots, b"root").hex(), sections)

    def __str__(self) -> str:
        """root:sections by ;, each its hash and paragraphs by comma, each its hash and leaves side by side."""
        return self.root + ":" + ";".join(h.hex() + "," + ",".join(p.hex() + b"".join(leaves).hex() for p, leaves in ps) for h, ps in self.sections)

    @classmethod
    def parse(cls, line: str) -> "Fingerprint":
        root, _, rest = line.partition(":")
        sections = []
        for s in rest.split(";") if rest else ():
            own, *ps = s.split(",")
            nodes = [(bytes.fromhex(p[:NODE_HEX]), [bytes.fromhex(p[k : k + LEAF_HEX]) for k in range(NODE_HEX, len(p), LEAF_HEX)]) for p in ps]
            sections.append((bytes.fromhex(own), nodes))
        return cls(root, sections)


def _unmatched(xs: list, ys: list) -> tuple[list[int], list[int]]:
    """Places of the nodes of either side that have no partner of equal hash on the other, each used once."""
    left = Counter(h for h, _ in ys)
    mine = [k for k, (h, _) in enumerate(xs) if not (left[h] and not left.subtract((h,)))]
    left = Counter(h for h, _ in xs)
    return mine, [k for k, (h, _) in enumerate(ys) if not (left[h] and not left.subtract((h,)))]


def descend(a: Fingerprint, b: Fingerprint) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) of the branches of a, and of b, that the other lacks; below equal hashes nothing is looked at."""
    if a.root == b.root:
        return [], []
    sections = _unmatched(a.sections, b.sections)
    places = [[(i, j) for i in mine for j in range(len(f.sections[i][1]))] for mine, f in zip(sections, (a, b))]
    nodes = [[f.sections[i][1][j] for i, j in at] for at, f in zip(places, (a, b))]
    x, y = _unmatched(*nodes)
    return [places[0][k] for k in x], [places[1][k] for k in y]


def likeness(a: Fingerprint, b: Fingerprint, branches: tuple | None = None) -> float:
    """Twice the shared leaves over all leaves, each as often as it comes; 1 for equal roots, 0 if one side has none."""
    if a.root == b.root:
        return 1.0
    total = [sum(len(leaves) for _, ps in f.sections for _, leaves in ps) for f in (a, b)]
    if not all(total):
        return 0.0
    rest = [Counter(x for i, j in at for x in f.sections[i][1][j][1]) for at, f in zip(branches or descend(a, b), (a, b))]
    lacking = sum((rest[0] - rest[1]).values()) + sum((rest[1] - rest[0]).values())
    return 1 - lacking / sum(total)


def differences(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int]]:
    """(section, paragraph) of a's branches that b lacks."""
    return descend(a, b)[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of docs(doc_id, text); a null text is an empty one, whose tree has no leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([str(Fingerprint.of(t or "")) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) by part, the guest first, then by id: each row's next document is the last one with a smaller id."""
    part, now, first, before = None, None, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            rows = []
            for p, guest, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                text = text or ""
                if p != part:
                    part, now, first, before = p, None, None, None
                own = (text, Fingerprint.of(text))
                if guest:
                    before = own
                    continue
                if doc is None:
                    following = None
                elif doc != now:
                    if now is not None:
                        before = first
                    now, first = doc, own
                    following = before
                else:
                    following = before
                half = len(text) // 2
                edited = text[: len(text) - half] + (following[0][:half] if following else "")
                changed = Fingerprint.of(edited)
                branches = descend(changed, own[1])
                near = likeness(changed, own[1], branches)
                after = likeness(own[1], following[1]) if following else None
                rows.append((doc, len(text), sha256(edited.encode(errors="surrogatepass")).hexdigest(), str(own[1]), str(changed), near, after, ",".join(f"{i}.{j}" for i, j in branches[0])))
            if rows:
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed) for every row of docs(doc_id, text).

    changed locates the edit: section.paragraph of the edited text's branches that the text lacks, comma-joined.

    The next document is that of the next smaller doc_id, after the smallest the largest one's; of several rows with that
    id it is the one whose text has the smallest hash, and a table's only document follows itself. Rows with a null
    doc_id have no next document: their edited text is the first half, near_next is null. No rows give none.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / width for k in range(1, width)] or [0.5], 10000)).first()[0] or []
    limits = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    # an id that is several bounds has more than one part's share of all rows: its rows are dealt to that many parts
    low = F.size(F.filter(limits, lambda x: x < F.col("doc_id")))
    spread = F.greatest(F.size(F.filter(limits, lambda x: x == F.col("doc_id"))), F.lit(1))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", low.alias("low"))
    on_bound = F.array_contains(limits, F.col("doc_id"))
    heads = ids.groupBy("low").agg(F.max("doc_id").alias("head"), F.max(F.when(~on_bound, F.col("doc_id"))).alias("below")).orderBy("low").collect()  # a row per part at most
    guests, previous = [], heads[-1]["head"] if heads else None
    for r in heads:
        guests.append((r["low"], previous))
        if r["low"] < len(bounds) and r["head"] == bounds[r["low"]]:
            more = sum(x == r["head"] for x in bounds)
            guests += [(r["low"] + k, previous if r["below"] is None else r["below"]) for k in range(1, more)]
        previous = r["head"]
    salt = F.pmod(F.xxhash64("text", F.spark_partition_id()), spread).cast("int")
    nowhere = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(width)).cast("int")
    own = docs.select(F.when(F.col("doc_id").isNull(), nowhere).otherwise(low + salt).alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    wanted = spark.createDataFrame(guests, "part int, doc_id long")
    first = docs.where(F.col("doc_id").isin(sorted({g for _, g in guests})))
    first = first.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    invited = first.join(F.broadcast(wanted), "doc_id").select("part", F.lit(1).alias("guest"), "doc_id", "text")  # at most a row per part
    dealt = own.union(invited).repartitionById(width, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", F.desc("guest"), F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_compare, _OUT)
