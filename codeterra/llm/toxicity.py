"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed word rates. It is trained with numpy on the driver from bounded samples: confirmed
toxic examples (P) and texts of any kind (U), none of which counts as clean. With class prior p and logistic loss l the
risk is p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)]); when the second part falls below zero, its gradient is turned
round, as the corrected estimator asks for. The samples are bounded by texts (POSITIVES, UNLABELLED) and by features of a
text (LEARNED), so what the driver holds is bounded in bytes. Scores are the model's probabilities; texts are scored where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.llm import textnum

BITS = 17
#: Words added to a text's length, so that one word in a short text weighs less.
SMOOTH = 30
#: Confirmed toxic texts and texts of any kind that are learned from, about.
POSITIVES = 4000
UNLABELLED = 12000
#: Features of highest rate that are learned from in a text; scoring takes all.
LEARNED = 2048
#: Features that are worked on at a time.
BLOCK = 1 << 18
#: Texts of the samples that a feature must be in.
LEAST_TEXTS = 8
#: Class prior where no labels tell.
PRIOR = 0.1
STEPS = 250
RATE = 0.05
#: L1 penalty, divided by the root of the number of positives: about the noise of a useless feature's gradient.
PENALTY = 0.006
SCALE = 100.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: a fifth, by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(words: textnum.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, rate) of the distinct features of each text."""
    of = np.repeat(np.arange(words.n_docs), words.counts)
    key = (of.astype(np.int64) << BITS) | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    key, many = np.unique(key, return_counts=True)
    of = key >> BITS
    return of, key & ((1 << BITS) - 1), SCALE * many / (words.counts[of] + SMOOTH)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, words in textnum.word_slices(batch.column(2), textnum.PLAIN_WORDS, lower=True):
            of, index, rate = features(words)
            cuts = np.searchsorted(of, np.arange(words.n_docs + 1))
            index, rate = index.astype(np.int32), rate.astype(np.float32)
            spans = [slice(a, b) if b - a <= LEARNED else a + np.sort(np.argsort(-rate[a:b], kind="stable")[:LEARNED]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            own = batch.slice(at, end - at)
            yield pa.record_batch([own.column(0), own.column(1), pa.array([index[x].tobytes() for x in spans], pa.binary()), pa.array([rate[x].tobytes() for x in spans], pa.binary())], names=["kind", "doc_id", "features", "rates"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, words: textnum.Words) -> np.ndarray:
        of, index, rate = features(words)
        margin = np.bincount(of, weights=self.weights[index] * rate, minlength=words.n_docs) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


class Sample:
    """Features of some texts as flat arrays: index and rate of each feature, ends the features up to each text's end."""

    def __init__(self, table: pa.Table):
        index, rate, counts = [], [], []
        for batch in table.to_batches():
            for column, kind, into in ((0, np.int32, index), (1, np.float32, rate)):
                offsets = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
                data = batch.column(column).buffers()[2]
                into.append(np.frombuffer(data, dtype=kind)[offsets[0] // 4 : offsets[-1] // 4] if data is not None else np.empty(0, dtype=kind))
            counts.append(np.diff(offsets) // 4)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        self.index, self.rate = join(index, np.int32), join(rate, np.float32)
        self.ends = np.cumsum(join(counts, np.int32), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    def keep(self, place: np.ndarray) -> None:
        """Leaves the features with place >= 0, under that number."""
        at = place[self.index]
        ok = at >= 0
        self.ends = np.concatenate(([0], np.cumsum(ok)))[self.ends]
        self.index, self.rate = at[ok], self.rate[ok]

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, text of each feature counted from the first, index, rate) of about BLOCK features at a time."""
        begin = 0
        while begin < len(self.ends):
            first = self.ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(self.ends, first + BLOCK, side="right")), begin + 1)
            at = slice(first, self.ends[end - 1])
            of = np.repeat(np.arange(end - begin), np.diff(np.concatenate(([first], self.ends[begin:end]))))
            yield slice(begin, end), of, self.index[at], self.rate[at]
            begin = end

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        out = np.full(len(self), b)
        for texts, of, index, rate in self.blocks():
            out[texts] += np.bincount(of, weights=w[index] * rate, minlength=texts.stop - texts.start)
        return out

    def pulled(self, pull: np.ndarray, k: int) -> np.ndarray:
        """The sum of rate times the text's pull, by feature."""
        out = np.zeros(k)
        for texts, of, index, rate in self.blocks():
            out += np.bincount(index, weights=pull[texts][of] * rate, minlength=k)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def risk(positives: Sample, unlabelled: Sample, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, the other part before it is held at zero, and the gradient (bias last) that a step follows.

    Where the other part is negative the step ascends it, and leaves the positives' part alone.
    """
    n_p, n_u = len(positives), len(unlabelled)
    mp, mu = positives.margins(w, b), unlabelled.margins(w, b)
    positive = prior * np.logaddexp(0, -mp).mean()
    negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
    if negative >= 0:
        gp, gu = -prior * _sigmoid(-mp) / n_p - prior * _sigmoid(mp) / n_p, _sigmoid(mu) / n_u
    else:
        gp, gu = prior * _sigmoid(mp) / n_p, -_sigmoid(mu) / n_u
    return positive, negative, np.append(positives.pulled(gp, len(w)) + unlabelled.pulled(gu, len(w)), gp.sum() + gu.sum())


def fit(positives: Sample, unlabelled: Sample, prior: float) -> Model:
    """nnPU by full-batch Adam with an L1 proximal step; without positives or unlabelled texts, the prior everywhere.

    The samples lose the features that too few texts have.
    """
    start = math.log(prior / (1 - prior))
    weights = np.zeros(1 << BITS)
    if not len(positives) or not len(unlabelled):
        return Model(weights, start, prior)
    texts = np.bincount(positives.index, minlength=1 << BITS) + np.bincount(unlabelled.index, minlength=1 << BITS)
    used = np.flatnonzero(texts >= min(LEAST_TEXTS, 1 + len(positives) // 8))
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    positives.keep(place)
    unlabelled.keep(place)
    k = len(used)
    penalty = PENALTY / math.sqrt(len(positives))
    w, b = np.zeros(k), start
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        _, _, g = risk(positives, unlabelled, prior, w, b)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        pace = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        move = pace * first / (1 - 0.9**step)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace[:-1] * penalty, 0.5), 0)
        b -= move[-1]
    weights[used] = w
    return Model(weights, float(b), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """From docs(doc_id, text) and labels(doc_id, toxic); labels of held-out rows, and null ones, are not read.

    Samples are those whose id's hash is below a threshold that lets about `positives` confirmed toxic ids and
    `unlabelled` texts pass; the prior is the toxic part of all labels that may be read. An id with several labels is toxic
    if one of them is; an id with several texts gives one.
    """
    ids = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = ids.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / n, 0.001), 0.999) if n else PRIOR
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.count()
    among = lambda seed, part: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30))
    # about `positives` ids, so they may be broadcast
    chosen = F.broadcast(ids.where((F.col("toxic") == 1) & among(0, positives / max(toxic or 0, 1))).select("doc_id"))
    some = docs.join(chosen, "doc_id").select(F.lit(1).alias("kind"), "doc_id", "text")
    some = some.union(docs.where(among(1, unlabelled / max(rows, 1)) & ~held_out(F.col("doc_id"))).select(F.lit(0).alias("kind"), "doc_id", "text"))
    some = some.mapInArrow(_featurize, "kind int, doc_id long, features binary, rates binary")
    got = some.groupBy("kind", "doc_id").agg(F.min(F.struct("features", "rates")).alias("x")).select("kind", "x.*").toArrow()
    p, u = (Sample(got.filter(pc.equal(got["kind"], kind)).select(["features", "rates"])) for kind in (1, 0))
    del got
    return fit(p, u, prior)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a column into (0 to 1, higher: likelier toxic) added for every row; a null or empty text gets what no word gives.

    A column of that name in docs is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(into)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(words) for _, _, words in textnum.word_slices(batch.column(place), textnum.PLAIN_WORDS, lower=True)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(into)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; rows with a null doc_id count as held out."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
