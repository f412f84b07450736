"""N-gram Jaccard join by PartEnum signatures, and the groups that its links make.

A text's set holds the hashes of its distinct shingles. Two sets with Jaccard >= t whose smaller one has n elements
differ in at most D(n) = n * (1 - t) / t elements. Each size band cuts the hash domain into first-level partitions of
CELLS = 3 second-level ones, of which one may differ: the subsets of two second-level partitions are enumerated, and a set's
projection on each, if not empty, is a signature. Let a first-level partition be worth 2 to a set that fills two of its
second-level ones or more, 1 to one that fills one. Of a partition with d differences both sets share at least its worth to
either less d signatures: without a difference all are equal, two or three; a single one leaves the subset without it equal,
which is empty only to a set that the partition is worth 1. Partitions are taken in one fixed order until their worth
reaches D(n) + 1 + SLACK(n); the set that reaches this first has taken no partition that the other has not, hence
similar sets share at least 1 + SLACK signatures. A set that runs out of partitions adds that many band-wide signatures. Sets near the top of a band also sign for the next one, so a
pair meets in the band of its larger set.

Signatures travel as sorted binary runs by signature bucket, not as single rows, and equal sets are one node from the
start; there are as many buckets as keep one within BUCKET signatures. A signature of more than HOT sets in one run leaves the
bucket's way: these members are matched where they land by chance, and only their leaders go to the bucket. Groups of
one signature give all pairs where small; a large group gives only links to a few leaders and along a ring, which keeps pairs
in proportion to signatures. Every candidate pair is verified on the whole sets. Large groups that are still in several
components after that are taken up again: pairs of small groups that such signatures may make up for are verified, too,
and nodes with more of them than their SLACK meet at rare elements, or are compared in blocks (see _settle), so no link
between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.llm import textnum
from codeterra.llm.lineage import cut, drop_stored, free, shuffle_width, stored
from codeterra.operators.components import components

SHINGLE = 5
THRESHOLD = (75, 100)
BAND_RATIO = 2
#: Second-level partitions of a first-level one.
CELLS = 3
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Signature groups up to this size give all pairs.
SMALL_GROUP = 6
LEADERS = 2
#: Members of a large signature group in one row, and members in one run that make a signature hot.
CHUNK = 4096
HOT = 2048
#: Signatures in a bucket, about.
BUCKET = 1_000_000
#: Sets compared with one another at a time when large groups are taken up again, and the open sets that a rare element may be in.
BLOCK = 256
FEW = 8
#: Signatures held in a task before they are sorted and handed on.
RUN = 1_000_000
#: Bytes of node ids that a task may hold to pick the candidates' texts; beyond, a shuffle join does.
BROADCAST_BYTES = 32 << 20


def shingle_sets(words: textnum.Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; of a text with fewer words, the whole sequence; of none, nothing."""
    grams, _ = words.grams(size)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([textnum.sequence_hash(words.hashes[a:b])], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)


def nodes_of(sets: list[np.ndarray]) -> list[int | None]:
    """63-bit names of sets: equal sets have equal names; an empty set has none."""
    out: list[int | None] = [None] * len(sets)
    filled = [k for k, s in enumerate(sets) if len(s)]
    if filled:
        h = np.concatenate([sets[k] for k in filled])
        at = np.cumsum([0] + [len(sets[k]) for k in filled[:-1]])
        names = textnum.mix64(np.add.reduceat(h, at) ^ np.add.reduceat(textnum.mix64(h), at)) >> np.uint64(1)
        for k, name in zip(filled, names.tolist()):
            out[k] = name
    return out


def slack_of(n: np.ndarray) -> np.ndarray:
    return n // 12 + 1


def slack(n: int) -> int:
    return n // 12 + 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before it, the first one included."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def signatures_of(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sorted sets of hashes, with the place of each one's set; a set too small to be similar to any other has none.

    Band i holds sizes from BAND_RATIO ** i to below BAND_RATIO ** (i + 1). A set signs in its own band, and in the next
    one if a similar larger set can be there. All sets are worked on at once.
    """
    num, den = threshold
    n = np.array([len(s) for s in sets], dtype=np.int64)
    some = np.flatnonzero(n * (den - num) // num >= 1)
    if not len(some):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    band = np.frexp(n[some].astype(np.float64))[1] - 1
    twice = n[some] * den >= (1 << (band + 1)) * num
    owner, band = np.concatenate((some, some[twice])), np.concatenate((band, band[twice] + 1)).astype(np.uint64)
    size, begin = n[owner], (np.cumsum(n) - n)[owner]
    quota = size * (den - num) // num + 1 + slack_of(size)
    seed = (band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # first-level partitions of a band: two to four elements in each for its sets, and enough of them for small sets
    cells = np.uint64(CELLS) * ((np.uint64(1) << band) // np.uint64(BAND_RATIO) + np.uint64(24))
    of = np.repeat(np.arange(len(owner)), size)
    h = np.concatenate(sets)[np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size)]
    # the domain is dealt by the high bits, so a sorted set is already in order of its second-level partitions
    cell = ((h >> np.uint64(32)) * cells[of]) >> np.uint64(32)
    first = _changes(of, cell)
    sums = textnum.mix64(np.add.reduceat(textnum.mix64(h ^ seed[of]), first))
    of, (part, inner) = of[first], np.divmod(cell[first], np.uint64(CELLS))
    head = _changes(of, part)
    filled = np.diff(np.append(head, len(part)))
    entry = of[head]
    worth = np.where(filled > 1, 2, 1)
    reached = np.cumsum(worth)
    before = reached - worth
    before -= before[_changes(entry)][entry]  # every entry has a partition
    used = before < quota[entry]
    grid = np.zeros((len(head), CELLS), dtype=np.uint64)
    grid[np.repeat(np.arange(len(head)), filled), inner.astype(np.int64)] = sums
    total = np.bincount(entry, weights=worth, minlength=len(owner)).astype(np.int64)
    grid, entry = grid[used], entry[used]
    name = textnum.mix64(part[head][used] ^ seed[entry])
    out, owners = [], []
    for left in range(CELLS):
        a, b = grid[:, left], grid[:, (left + 1) % CELLS]
        some = (a | b) != 0
        out.append(textnum.mix64(a[some] + b[some] * _ODD + name[some] * np.uint64(2 * left + 3)))
        owners.append(owner[entry[some]])
    for k in np.flatnonzero(total < quota).tolist():
        out.append(textnum.mix64(seed[k] + np.arange(1, 1 + slack(int(size[k])) + 1, dtype=np.uint64)))
        owners.append(np.full(len(out[-1]), owner[k]))
    return np.concatenate(out), np.concatenate(owners)


def _pack(sigs: np.ndarray, at: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, hot: np.ndarray | None = None) -> bytes:
    """A run; without marks of hot signatures' leaders, it is one hot signature's members."""
    used, again = np.unique(at, return_inverse=True)
    again = again.astype(np.uint32)
    if hot is not None:
        again |= hot.astype(np.uint32) << np.uint32(31)
    head = np.array([len(sigs) if hot is not None else -len(sigs), len(used)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, sigs, nodes[used], sizes[used], again))


def _unpack(blob: bytes) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether it is a hot signature's run; signatures with the node and set size of each, and marks of leaders."""
    n, m = np.frombuffer(blob, dtype=np.int64, count=2).tolist()
    alone, n = n < 0, abs(n)
    sigs = np.frombuffer(blob, dtype=np.uint64, count=n, offset=16)
    nodes = np.frombuffer(blob, dtype=np.int64, count=m, offset=16 + 8 * n)
    sizes = np.frombuffer(blob, dtype=np.uint32, count=m, offset=16 + 8 * n + 8 * m)
    at = np.frombuffer(blob, dtype=np.uint32, count=n, offset=16 + 8 * n + 12 * m)
    own = at & np.uint32(0x7FFFFFFF)
    return alone, sigs, nodes[own], sizes[own], (at >> np.uint32(31)).astype(bool) | alone


def _sign(buckets: int, hot_from: int):
    # the least signature of each bucket
    limits = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, nodes, sizes, known = [], [], [], [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            s, o, names, many = np.concatenate(sigs), np.concatenate(owners), np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.uint32)
            sigs.clear()
            owners.clear()
            order = np.argsort(s, kind="stable")
            s, o = s[order], o[order]
            del order
            rows, hot = [], np.zeros(len(s), dtype=bool)
            # a hot signature's members go out by themselves, to any bucket; its leaders stand for them in its own
            often = np.unique(s[hot_from:][s[hot_from:] == s[:-hot_from]]) if len(s) > hot_from else s[:0]
            if len(often):
                keep = np.ones(len(s), dtype=bool)
                for a, b in zip(np.searchsorted(s, often, side="left").tolist(), np.searchsorted(s, often, side="right").tolist()):
                    lead = a + np.argsort(names[o[a:b]])[:LEADERS]
                    keep[a:b] = False
                    keep[lead] = hot[lead] = True
                    for x in range(a, b, CHUNK):
                        y = min(x + CHUNK, b)
                        rows.append((int((names[o[x]] ^ int(s[x] >> np.uint64(1))) % buckets), _pack(s[x:y], o[x:y], names, many)))
                s, o, hot = s[keep], o[keep], hot[keep]
            cuts = np.append(np.searchsorted(s, limits), len(s)).tolist()
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                if y > x:
                    rows.append((b, _pack(s[x:y], o[x:y], names, many, hot[x:y])))
                if len(rows) >= 64 or b + 1 == buckets:
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "run"])
                    rows = []

        held = 0
        for batch in batches:
            for _, _, words in textnum.word_slices(batch.column(0), textnum.BLANK_WORDS, lower=True):
                sets = list(shingle_sets(words))
                fresh = []
                for s, node in zip(sets, nodes_of(sets)):
                    if node is not None and node not in known:
                        known.add(node)
                        fresh.append(s)
                        nodes.append(node)
                        sizes.append(len(s))
                sig, of = signatures_of(fresh)
                sigs.append(sig)
                owners.append((of + len(nodes) - len(fresh)).astype(np.uint32))
                held += len(sig)
                if held >= RUN:
                    yield from flush()
                    nodes.clear()
                    sizes.clear()
                    known.clear()
                    held = 0
                    textnum.give_back()
        yield from flush()
        textnum.give_back()

    return run


def candidate_pairs(sigs: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, hot: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
    """From one bucket's signatures: columns low, high, signatures shared here and signatures that similar sets of these sizes share; the large groups.

    Small groups give all pairs, large ones (and all with a mark of a hot signature) their leaders' and a ring's. Pairs that
    sizes rule out are left out.
    """
    order = np.lexsort((~hot, nodes, sigs))
    sigs, nodes, sizes, hot = sigs[order], nodes[order], sizes[order].astype(np.int64), hot[order]
    keep = np.ones(len(sigs), dtype=bool)
    keep[1:] = (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])
    sigs, nodes, sizes, hot = sigs[keep], nodes[keep], sizes[keep], hot[keep]
    first = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    many = np.diff(np.append(first, len(sigs)))
    # a group with a mark counts as large
    weigh = np.where(np.logical_or.reduceat(hot, first), np.maximum(many, SMALL_GROUP + 1), many) if len(first) else many
    own = np.repeat(np.arange(len(first)), many)
    rank, size = np.arange(len(sigs)) - first[own], weigh[own]
    lows, highs = [], []
    for back in range(1, SMALL_GROUP):
        at = np.flatnonzero((rank >= back) & ((size <= SMALL_GROUP) | (back == 1)))
        lows.append(at - back)
        highs.append(at)
    for lead in range(LEADERS):
        at = np.flatnonzero((size > SMALL_GROUP) & (rank > lead + 1))
        lows.append(first[own[at]] + lead)
        highs.append(at)
    low, high = np.concatenate(lows), np.concatenate(highs)
    few = np.minimum(sizes[low], sizes[high])
    fits = few * threshold[1] >= np.maximum(sizes[low], sizes[high]) * threshold[0]
    low, high, few = nodes[low[fits]], nodes[high[fits]], few[fits]
    order = np.lexsort((high, low))
    low, high, few = low[order], high[order], few[order]
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(low) else order
    shared = np.diff(np.append(new, len(low)))
    large = [(int(sigs[f] >> np.uint64(1)), nodes[f : f + n]) for f, n in zip(first[weigh > SMALL_GROUP].tolist(), many[weigh > SMALL_GROUP].tolist())]
    return [low[new], high[new], shared, few[new] // 12 + 2], large


_MATCHED = "low long, high long, shared long, need long, sig long, members array<long>"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, runs = None, []
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
    names = ["low", "high", "shared", "need", "sig", "members"]

    def done(got: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not got:
            return
        pairs, large = candidate_pairs(*(np.concatenate([g[k] for g in got]) for k in range(4)))
        for k in range(0, len(pairs[0]), 1 << 16):
            part = [pa.array(x[k : k + (1 << 16)], pa.int64()) for x in pairs]
            yield pa.record_batch([*part, pa.nulls(len(part[0]), kinds[4]), pa.nulls(len(part[0]), kinds[5])], names=names)
        chunks = [(sig, members[k : k + CHUNK]) for sig, members in large for k in range(0, len(members), CHUNK)]
        for k in range(0, len(chunks), 64):
            part = chunks[k : k + 64]
            yield pa.record_batch([*(pa.nulls(len(part), kinds[c]) for c in range(4)), pa.array([c[0] for c in part], kinds[4]), pa.array([c[1] for c in part], kinds[5])], names=names)

    for batch in batches:
        for b, run in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket:
                yield from done(runs)
                bucket, runs = b, []
            alone, *got = _unpack(run.as_py())
            if alone:
                yield from done([got])
            else:
                runs.append(got)
    yield from done(runs)
    runs.clear()
    textnum.give_back()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes = [], []
        for _, _, words in textnum.word_slices(batch.column(1), textnum.BLANK_WORDS, lower=True):
            sets = list(shingle_sets(words))
            sizes += [len(s) for s in sets]
            nodes += nodes_of(sets)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], names=["doc_id", "row", "n_shingles", "node"])
    textnum.give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, words in textnum.word_slices(batch.column(1), textnum.BLANK_WORDS, lower=True):
            sets = list(shingle_sets(words))
            nodes = batch.column(0).slice(at, end - at)
            mine = pa.array([n == own for n, own in zip(nodes.to_pylist(), nodes_of(sets))], pa.bool_())
            yield pa.record_batch([nodes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(mine)
    textnum.give_back()


def _verify(threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, left = [], None, None
            for low, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if low != last:
                    last, left = low, np.frombuffer(a.as_py(), dtype=np.uint64)
                right = np.frombuffer(b.as_py(), dtype=np.uint64)
                total = len(left) + len(right)
                # |union| = total - same, so same * (num + den) >= num * total
                if min(len(left), len(right)) * (threshold[0] + threshold[1]) < threshold[0] * total:
                    ok.append(False)
                    continue
                few, many = (left, right) if len(left) <= len(right) else (right, left)
                at = np.searchsorted(many, few)
                at[at == len(many)] = 0
                same = int((many[at] == few).sum())
                ok.append(same * (threshold[0] + threshold[1]) >= threshold[0] * total)
            mask = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(mask)
        textnum.give_back()

    return run


def _block_links(threshold: tuple[int, int]):
    """Links between components among the sets of two blocks: as many as join what they connect, one less than that has components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        same = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for at in range(0, len(values), 4096):
            here = (column >= at) & (column < at + 4096)
            grid = np.zeros((len(sets), 4096), dtype=np.float32)
            grid[owner[here], column[here] - at] = 1
            same += grid @ grid.T
        total = sizes[:, None] + sizes[None, :]
        group, node = pdf["low"].to_numpy(), pdf["node"].to_numpy()
        similar = same * sum(threshold) >= threshold[0] * total
        # a walk through similar sets and through components; its steps between components are the links
        unseen, links = np.ones(len(sets), dtype=bool), []
        for start in range(len(sets)):
            front = [start] if unseen[start] else []
            unseen[start] = False
            while front:
                at = front.pop()
                own = group == group[at]
                new = unseen & (similar[at] | own)
                front += np.flatnonzero(new).tolist()
                links += [(node[at], node[k]) for k in np.flatnonzero(new & ~own).tolist()]
                unseen &= ~new
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, low, shingles) -> a row for each element."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [np.frombuffer(x.as_py(), dtype=np.int64) for x in part.column(2)]
            many = [len(x) for x in sets]
            node, low = (np.repeat(part.column(k).to_numpy(), many) for k in (0, 1))
            yield pa.record_batch([pa.array(node), pa.array(low), pa.array(np.repeat(many, many).astype(np.int64)), pa.array(np.concatenate(sets))], names=["node", "low", "n", "h"])
    textnum.give_back()


def _links(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (low, high) whose sets are similar, as links (u, v)."""
    left = sets.select(F.col("node").alias("low"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("high"), F.col("shingles").alias("b"))
    both = pairs.join(right, "high").join(left, "low").select("low", "high", "a", "b")
    return both.mapInArrow(_verify(threshold), "u long, v long")


def _settle(large: DataFrame, pairs: DataFrame, facts: DataFrame, groups: DataFrame, sets_of, threshold: tuple[int, int]) -> DataFrame | None:
    """Links that large signature groups still hide, given large(sig, node), pairs(low, high, shared, need) by bucket and groups(node, low) found so far.

    A group inside one component hides none. Similar sets share 1 + SLACK signatures or more. If they share one of a
    small group, they are among the pairs; counted too low there, the rest of their signatures is in groups unsettled
    for both, so such pairs are verified. If they share none of a small group, a node with no more than SLACK (of the
    smallest partner it can have) of its groups unsettled has met each of these partners in a settled group. The others
    are open; they take up the search by single elements, those in more than FEW open sets last. Of two
    similar sets each has at most n * (1 - t) elements that the other lacks, so the first shared element, in one order
    for all, is among the first n * (1 - t) + 1 of both: sets meet at elements that few have. Only a set with less such
    elements than that, most of which is therefore common text, can be similar to another without meeting it, and then
    the other is such a set, too. These are compared in blocks, with those of their size and their unsettled groups.
    """
    num, den = threshold
    named = large.join(groups, "node", "left").select("sig", "node", F.coalesce("low", "node").alias("low"))
    split = named.groupBy("sig").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a <> b").select("sig")
    named = named.join(split, "sig")
    unsettled = cut(named.groupBy("node", "low").agg(F.count("*").alias("n")))
    if unsettled.isEmpty():
        return None
    left, right = (unsettled.select(F.col("node").alias(x), F.col("low").alias(f"{x}_group"), F.col("n").alias(f"{x}_n")) for x in ("low", "high"))
    doubtful = pairs.join(left, "low").join(right, "high").where("low_group <> high_group")
    doubtful = doubtful.groupBy("low", "high").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.min(F.least("low_n", "high_n")).alias("more"))
    doubtful = cut(doubtful.where("shared < need and shared + more >= need").select("low", "high"))
    met = None
    if not doubtful.isEmpty():
        met = cut(_links(doubtful, sets_of(doubtful.select(F.explode(F.array("low", "high")).alias("node"))), threshold))
    least = F.floor(F.floor(F.col("n_shingles") * num / den) / 12) + 1
    sizes = facts.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"))
    open_ = unsettled.join(sizes, "node").where(F.col("n") > least).select("node")
    named = cut(named.join(open_, "node"))
    if named.isEmpty():
        return met
    nodes = named.select("node", "low").distinct()
    sets = stored(nodes.join(sets_of(nodes.select("node")), "node").select("node", "low", "shingles"))
    elements = stored(sets.mapInArrow(_elements, "node long, low long, n long, h long"))
    common = elements.groupBy("h").count().where(F.col("count") > FEW).select("h")
    first = F.floor(F.col("n") * (den - num) / den).cast("int") + 1
    rare = elements.join(common, "h", "left_anti").groupBy("node", "low", "n").agg(F.sort_array(F.collect_list("h")).alias("rare"))
    rare = stored(rare.select("node", "low", "n", F.size("rare").alias("held"), F.slice("rare", F.lit(1), first).alias("first")))
    made = [sets, elements, rare]
    meet = rare.select(F.struct("node", "low", "n").alias("x"), F.explode("first").alias("h")).groupBy("h").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    meet = meet.select("xs", F.explode("xs").alias("a")).select("a", F.explode("xs").alias("b")).where("a.node < b.node and a.low <> b.low")  # at most FEW of one element
    fits = F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num
    pairs = meet.where(fits).select(F.col("a.node").alias("low"), F.col("b.node").alias("high")).distinct()
    found = cut(_links(pairs, sets, threshold))
    spent = sets.select("node").join(rare.where(F.col("held") >= first).select("node"), "node", "left_anti")
    named = named.join(spent, "node", "left_semi")
    split = named.groupBy("sig").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.min("node").alias("lead")).where("a <> b")
    named = cut(named.join(split.select("sig", "lead"), "sig").select("node", "low", "lead").distinct())
    if not named.isEmpty():
        family = components(named.select(F.col("node").alias("u"), F.col("lead").alias("v"))).withColumnRenamed("low", "family")
        tied = named.select("node", "low").distinct().join(family, "node").join(sets.select("node", "shingles"), "node")
        # similar sets are of one size class or of two neighbours; the smaller one is compared in both
        size = F.floor(F.log(F.octet_length("shingles") / 8.0) / math.log(den / num) + 1e-9).cast("int")
        tied = stored(tied.withColumn("size", F.explode(F.array(size, size + 1))))
        made.append(tied)
        # a family's largest component needs no comparison with itself: its blocks only meet those of the rest
        parts = tied.groupBy("family", "size", "low").agg(F.count("*").alias("n"))
        parts = parts.groupBy("family", "size").agg(F.max(F.struct("n", "low")).alias("main"), F.sum("n").alias("all"))
        parts = parts.where("all > main.n").select("family", "size", F.col("main.low").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("rests"))
        tied = tied.join(parts, ["family", "size"]).withColumn("is_main", F.col("low") == F.col("main"))
        # blocks of about BLOCK by hash, so that no family is numbered in one task
        k = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests")))
        to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
        among = F.transform(to(F.col("rests")), lambda x: cell("rest", F.least("k", x), F.greatest("k", x)))
        across = F.transform(to(F.col("mains")), lambda x: cell("main", F.col("k"), x))
        tied = tied.withColumn("k", k).withColumn("cell", F.explode(F.when(F.col("is_main"), F.transform(to(F.col("rests")), lambda x: cell("main", x, F.col("k")))).otherwise(F.concat(among, across))))
        key = ["family", "size", "kind", "i", "j"]
        tied = tied.select("family", "size", "cell.*", "node", "low", "shingles").repartition(*key)  # else a whole family would stay in one task
        found = found.union(tied.groupBy(*key).applyInPandas(_block_links(threshold), "u long, v long"))
    found = cut(found if met is None else found.union(met))
    for x in made:
        drop_stored(x)
    return found


def grouped(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row, n_shingles, group, component_id) for every row of docs(doc_id, text).

    row is the hash of the text, group names what its links reach (null for texts without words); see near_duplicates().
    Rows of one doc_id with different texts are in the groups of their texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    width = shuffle_width(spark)
    facts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    facts = cut(facts.mapInArrow(_facts, "doc_id long, row long, n_shingles long, node long"))
    classes = facts.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    # a set has about twice as many signatures as elements, at most
    buckets = max(4 * width, -(-(facts.agg(F.sum("n_shingles")).first()[0] or 0) // bucket))
    runs = docs.select("text").mapInArrow(_sign(buckets, hot), "bucket int, run binary")
    matched = stored(runs.repartition(-(-buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_match, _MATCHED))
    # similar sets share `need` signatures; a true pair counted too low in large groups is found when these are settled
    counted = matched.where("low is not null").select("low", "high", "shared", "need")
    pairs = counted.groupBy("low", "high").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    pairs = cut(pairs.where("shared >= need").select("low", "high"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.distinct().join(classes, "node"))
        chosen = wanted if 16 * wanted.count() > BROADCAST_BYTES else F.broadcast(wanted)
        texts = docs.join(chosen, docs.doc_id == chosen.rep).select("node", "text")
        return texts.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"])

    texts = stored(sets_of(pairs.select(F.explode(F.array("low", "high")).alias("node"))))
    links = cut(_links(pairs, texts, threshold))
    groups = components(links)
    large = matched.where("sig is not null").select("sig", F.explode("members").alias("node")).distinct()
    more = _settle(large, counted, facts.where("node is not null"), groups, sets_of, threshold)
    if more is not None:
        groups = components(links.union(more))
    low = classes.join(groups, "node", "left").select("node", "rep", F.coalesce("low", "node").alias("group"))
    smallest = low.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = low.join(smallest, "group").select("node", "group", "component_id")
    out = cut(facts.join(named, "node", "left").select("doc_id", "row", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id")))
    drop_stored(matched)
    drop_stored(texts)
    return out


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links of Jaccard >= threshold, itself included. Null and blank
    texts have n_shingles 0 and stand alone. Equal texts are one set. Repeated rows come back repeated. Rows with a null
    doc_id are returned, with the component of their set; a set that only such rows have is not compared with others.
    An empty table gives no rows. Other columns of docs are ignored.
    """
    return grouped(docs, threshold, hot, bucket).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group that grouped() finds: that of the smallest doc_id (null last), of these that of the smallest hash of its text.

    Rows without words are in no group and all stay.
    """
    found = grouped(docs, threshold)
    row, key = free("row", docs.columns), free("key", docs.columns)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = found.where("group is not null").groupBy("group").agg(first.alias("first")).select(F.col("first.doc_id").alias(key), F.col("first.row").alias(row))
    hashed = docs.withColumn(row, F.xxhash64("text"))
    wordless = F.coalesce(F.length(F.translate("text", " \t\n\x0b\f\r", "")), F.lit(0)) == 0
    keep = keep.select(F.col(key).alias(f"{key}_"), F.col(row).alias(f"{row}_"))
    named = hashed.where(~wordless).join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(f"{key}_")) & (F.col(row) == F.col(f"{row}_")), "left_semi")
    return named.dropDuplicates(["doc_id", row]).select(*docs.columns).union(docs.where(wordless))
