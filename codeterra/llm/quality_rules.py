"""Quality by a sparse rule ensemble over text statistics.

Statistics are Column expressions. Small boosted trees are fitted to those of a bounded sample of labelled rows; each path
from a root to a node is a conjunctive rule; an L1-penalised logistic regression over all rules keeps few of them, and
the kept rules are compiled into Column expressions, so that scoring stays in Spark's own operators and meets no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeterra.llm.lineage import free

#: Labelled ids that are learned from, about; chosen by hash of the id.
SAMPLE = 20_000
TREES = 30
DEPTH = 3
#: Rows in a leaf and candidate thresholds of a statistic.
LEAST_ROWS = 10
CUTS = 24
SHRINK = 0.3
#: L1 penalty on the mean loss, and steps of the proximal gradient.
PENALTY = 0.0015
STEPS = 400
#: Score where no labels tell.
PRIOR = 0.5

STATISTICS = ("n_words", "word_length", "distinct_words", "symbols", "capitals", "digits", "stops", "short_words", "lines", "distinct_share")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: a fifth, by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(text) with a column __s_<name> for each of STATISTICS, none of them null; shares are of characters or words.

    Columns of docs with these names are replaced, all others are kept.
    """
    t, w = free("__t", docs.columns), free("__w", docs.columns)
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop(*[f"__s_{name}" for name in STATISTICS])
    docs = docs.withColumn(t, text).withColumn(w, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    counts = {
        "n": F.length(t),
        "k": F.size(w),
        "u": F.size(F.array_distinct(w)),
        "short": F.size(F.filter(w, lambda x: F.length(x) <= 3)),
        "symbols": F.length(F.regexp_replace(t, r"[^#$%&*|<>{}\[\]@^~=+_\\!/]+", "")),
        "capitals": F.length(F.regexp_replace(t, "[^A-Z]+", "")),
        "digits": F.length(F.regexp_replace(t, "[^0-9]+", "")),
        "stops": F.length(F.regexp_replace(t, "[^.,;:?]+", "")),
        "lines": F.length(F.regexp_replace(t, "[^\n]+", "")),
    }
    # columns of their own: fields of a struct would be computed again wherever they are used
    inner = {name: free(f"__c_{name}", docs.columns) for name in counts}
    docs = docs.withColumns({inner[name]: x for name, x in counts.items()})
    of = {name: F.col(c) for name, c in inner.items()}
    n, k = F.greatest(of["n"], F.lit(1)), F.greatest(of["k"], F.lit(1))
    found = {
        "n_words": of["k"].cast("double"),
        "word_length": of["n"] / k,
        # short texts repeat little: distinct words against what so many words usually have
        "distinct_words": of["u"] / F.pow(k.cast("double"), F.lit(0.8)),
        "symbols": of["symbols"] / n,
        "capitals": of["capitals"] / n,
        "digits": of["digits"] / n,
        "stops": of["stops"] / k,
        "short_words": of["short"] / k,
        "lines": of["lines"] / k,
        "distinct_share": of["u"] / k,
    }
    docs = docs.withColumns({f"__s_{name}": found[name] for name in STATISTICS})
    return docs.drop(t, w, *inner.values())


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater?, threshold), all of which hold


def _grow(x: np.ndarray, pull: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """A regression tree on gradients: adds the paths of its nodes to out and its leaves' steps to step."""
    g, h = pull[rows].sum(), curve[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        base = g * g / (h + 1)
        for s, places in enumerate(cuts):
            at = np.searchsorted(places, x[rows, s], side="left")  # values above places[k] come after k
            many = np.cumsum(np.bincount(at, minlength=len(places) + 1))[:-1]
            left_g = np.cumsum(np.bincount(at, weights=pull[rows], minlength=len(places) + 1))[:-1]
            left_h = np.cumsum(np.bincount(at, weights=curve[rows], minlength=len(places) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - base
            gain[(many < LEAST_ROWS) | (len(rows) - many < LEAST_ROWS)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (s, float(places[int(gain.argmax())])))
    if best[1] is None:
        step[rows] += SHRINK * g / (h + 1)
        return
    s, limit = best[1]
    above = x[rows, s] > limit
    for greater in (False, True):
        longer = (*path, (s, greater, limit))
        out.append(longer)
        _grow(x, pull, curve, cuts, rows[above == greater], longer, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees, in order of growth; each tree sees half of the rows, by turns."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, CUTS + 1)[1:-1])) for s in range(x.shape[1])]
    margin, found = np.zeros(len(y)), []
    order = np.arange(len(y))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        half = order if len(y) < 200 else order[(order * 7 + t * 13) % 16 < 8]
        _grow(x, y - p, p * (1 - p), cuts, half, (), found, step)
        margin += step
    return list(dict.fromkeys(tuple(sorted(r)) for r in found))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for s, greater, limit in rule:
        ok &= (x[:, s] > limit) == greater
    return ok


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 from the columns of with_statistics()."""
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for s, greater, limit in rule:
                column = F.col(f"__s_{STATISTICS[s]}")
                test = column > limit if greater else column <= limit
                holds = test if holds is None else holds & test
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same by numpy."""
        margin = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            margin += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """From statistics and labels of one sample; with one label or none, its smoothed part everywhere."""
    part = (y.sum() + 2 * PRIOR) / (len(y) + 2)
    start = math.log(part / (1 - part))
    if len(np.unique(y)) < 2:
        return Model(start, [])
    rules = tree_rules(x, y)
    table = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32)
    # the fastest step that is safe: the largest curvature of the mean loss, by power iteration
    v = np.ones(table.shape[1] + 1)
    for _ in range(20):
        u = table.T @ (table @ v[:-1] + v[-1])
        v = np.append(u, (table @ v[:-1] + v[-1]).sum())
        size = np.linalg.norm(v)
        v /= size
    pace = 4 * len(y) / size
    w, b = np.zeros(table.shape[1]), start
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(table @ ahead_w + ahead_b)))
        new = ahead_w - pace * (table.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * PENALTY, 0)
        new_b = ahead_b - pace * float((p - y).mean())
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return Model(float(b), [(r, float(k)) for r, k in zip(rules, w) if abs(k) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From docs(doc_id, text) and labels(doc_id, quality): labelled ids whose hash is below a threshold that lets about `sample` pass.

    No held-out or null label is read. Of several labels the higher counts, of several texts of an id one.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    part = min(1.0, sample / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # about `sample` ids
    found = with_statistics(rows).groupBy("doc_id").agg(F.min(F.struct("y", *[f"__s_{s}" for s in STATISTICS])).alias("x"))
    got = found.select("doc_id", "x.*").toPandas().sort_values("doc_id")
    return fit(got[[f"__s_{s}" for s in STATISTICS]].to_numpy(dtype=np.float64), got["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text) with a column score for every row; a null text scores as an empty one, a column of that name is replaced."""
    return with_statistics(docs).withColumn("score", model.score()).drop(*[f"__s_{s}" for s in STATISTICS])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; rows with a null doc_id count as held out. Without labels all score PRIOR."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
