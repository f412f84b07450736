"""Whitening of embeddings by a residue-number scatter.

Entries become integers. Each task multiplies its rows' residues by one another modulo several primes below 2 ** 20, as
floating-point matrix products that are exact because CHUNK rows keep every sum below 2 ** 53. A column of ones beside the
entries makes one scatter of counts, sums and products. Residues are summed row by row of the matrix in a shuffle, each
key in one running sum, and the driver sees one matrix for each prime: Chinese remaindering gives the exact integers, which
only then become a covariance in floating point, so an offset common to all rows cancels without loss. A symmetric
eigendecomposition in double precision gives the components.

What the driver holds grows with the square of the dimension, not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.llm.lineage import shuffle_width, stored

COMPONENTS = 8
SCALE = 1024.0
OFFSET = 100_000
#: Entries of this size or more are no integers that a long can hold with room for the offset.
LARGEST = float(1 << 62)
PRIME_BITS = 20
CHUNK = 4096
#: Components whose part of the largest eigenvalue is lower are rounding, not variance.
RANK = 1e-13
_HALF = 62


def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS whose product has more than so many bits."""
    found, product, at = [], 1, (1 << PRIME_BITS) - 1
    while product.bit_length() <= bits:
        if all(at % k for k in range(3, int(at**0.5) + 1, 2)):
            found.append(at)
            product *= at
        at -= 2
    return found


def remainder(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """Integers of either sign, of absolute value below half the moduli's product, from their residues; residues come by modulus."""
    whole = 1
    for p in moduli:
        whole *= p
    parts = [whole // p * pow(whole // p, -1, p) for p in moduli]
    found = [sum(r * part for r, part in zip(entry, parts)) % whole for entry in zip(*residues)]
    return [x - whole if 2 * x > whole else x for x in found]


def integers(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector (of dim entries) without null, non-finite or too large entries, and these vectors as integers (a row of different length is left out if dim is given)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without the entries of null rows
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)
        good = np.abs(scaled) < LARGEST
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~good)))
    keep = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if dim is not None:
        keep &= sizes == dim
    return keep, scaled[np.repeat(keep, sizes)].astype(np.int64) + OFFSET


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length of vector: how many there are, and the largest absolute entry."""
    count: dict[int, int] = {}
    most: dict[int, int] = {}
    for batch in batches:
        keep, x = integers(batch.column(0))
        sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)
        high = np.maximum.reduceat(np.abs(x), np.cumsum(sizes) - sizes) if len(sizes) else sizes
        for dim in np.unique(sizes).tolist():
            count[dim] = count.get(dim, 0) + int((sizes == dim).sum())
            most[dim] = max(most.get(dim, 0), int(high[sizes == dim].max()))
    yield pa.record_batch([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([most[d] for d in count], pa.int64())], names=["dim", "n", "most"])


def _products(dim: int, moduli: list[int]):
    """Rows of the task's scatter of (1, x), by prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), dim + 1, dim + 1), dtype=np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), dim)
            x = x.reshape(-1, dim)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                for k, p in enumerate(moduli):
                    r = np.ones((len(part), dim + 1))
                    r[:, 1:] = np.mod(part, p)
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        where = [(k, i) for k in range(len(moduli)) for i in range(dim + 1)] if sums.any() else []
        yield _rows(where, [sums[k, i] for k, i in where])

    return run


def _rows(where: list[tuple[int, int]], values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in where], pa.int32()), pa.array([i for _, i in where], pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["prime", "row", "residues"])


def _add(moduli: list[int]):
    """Residues of one (prime, row) added up; a task holds one running sum for each key that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, residues in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = np.frombuffer(residues.as_py(), dtype=np.int64)
                held[k, i] = (held[k, i] + got) % moduli[k] if (k, i) in held else got
        yield _rows(list(held), list(held.values()))

    return run


def scatter(vectors: DataFrame, dim: int, n: int, most: int) -> list[list[int]]:
    """The exact sums of (1, x) times (1, x) over the column of vectors that have dim entries, none of absolute value above most, as Python's integers."""
    moduli = primes((2 * n * max(most, 1) ** 2 + 1).bit_length())
    parts = vectors.mapInArrow(_products(dim, moduli), "prime int, row int, residues binary")
    summed = parts.repartition(min(shuffle_width(vectors.sparkSession), len(moduli) * (dim + 1)), "prime", "row").mapInArrow(_add(moduli), parts.schema)
    by: dict[tuple[int, int], list[int]] = {(r["prime"], r["row"]): np.frombuffer(r["residues"], dtype=np.int64).tolist() for r in summed.collect()}  # a matrix for each prime
    return [remainder([by[k, i] for k in range(len(moduli))], moduli) for i in range(dim + 1)]


@dataclass
class Whitening:
    """n vectors with entry sums, covariance trace, and components by falling eigenvalue (a component is a column of vectors)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (n * x - sums) ** 2 as high * 2 ** 62 + low, and (x - sums / n) for the projection."""
        high = np.zeros(len(x), dtype=np.int64)
        limit = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if limit**2 * max(len(self.sums), 1) < 1 << _HALF + 1:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.stack((high, (y * y).sum(axis=1)), axis=1), y / self.n
        y = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        exact = (y * y).sum(axis=1)
        parts = [(v >> _HALF, v & (1 << _HALF) - 1) for v in exact.tolist()]
        return np.array(parts, dtype=np.int64).reshape(-1, 2), (y / self.n).astype(np.float64)


def fit(moments: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor n, exact until it is rounded once) from the exact scatter; those without variance are left out."""
    n, sums = moments[0][0], moments[0][1:]
    dim = len(sums)
    covariance = np.array([[(n * moments[i + 1][j + 1] - sums[i] * sums[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    trace = sum(n * moments[i + 1][i + 1] - sums[i] ** 2 for i in range(dim)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > RANK * max(values.max(initial=0.0), 0.0)
    return Whitening(n, sums, trace, values[some], vectors[:, some])


def _project(model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = model.value
        scale = w.vectors / np.sqrt(w.values)
        for batch in batches:
            keep, x = integers(batch.column(1), dim)
            x = x.reshape(-1, dim)
            deviation, centred = w.deviations(x)
            white = centred @ scale
            many = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            white = pa.ListArray.from_arrays(many, pa.array(white.ravel()))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), pa.array(deviation[:, 0]), pa.array(deviation[:, 1]), white], names=["id", "high", "low", "white"])

    return run


OUTPUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): for each vector of rows(id, vector) its whitened coordinates.

    The vectors are those without null, non-finite or huge (2 ** 62 / 1024) entries, and with as many entries as most
    of these have (of equally many the longer); n of them. Other rows, null and empty vectors are left out and count
    nowhere. whitened is a vector's projection on a component over the root of its eigenvalue; components without variance
    (below RANK of the largest eigenvalue) do not come, so equal vectors alone, a single vector or an empty table give no
    rows. deviation, the sum of (n * x - sums) ** 2, is exact. identity_error is the largest absolute entry of the whitened
    coordinates' covariance minus the identity, taken over all rows. Rows with one id, or none, come back as often as they
    are there. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_column]
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    found = rows.select("vector").mapInArrow(_measure, "dim int, n long, most long").groupBy("dim").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    found = found.orderBy(F.desc("n"), F.desc("dim")).first()
    empty = spark.createDataFrame([], f"`{id_column}` {kind}, {OUTPUT}")
    if found is None:
        return empty
    dim = found["dim"]
    model = fit(scatter(rows.select("vector"), dim, found["n"], found["most"]), components)
    if not len(model.values):
        return empty
    white = rows.mapInArrow(_project(spark.sparkContext.broadcast(model), dim), f"id {kind}, high long, low long, white array<double>")
    white = stored(white)
    each = [F.col("white")[k] for k in range(len(model.values))]
    pairs = [(i, j) for i in range(len(each)) for j in range(i, len(each))]
    errors = [F.abs(F.covar_pop(each[i], each[j]) - F.lit(float(i == j))) for i, j in pairs]
    row = white.agg(F.array_max(F.array(*errors)).alias("worst")).first()
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    deviation = (F.col("high").cast("decimal(19,0)") * F.lit(1 << _HALF).cast("decimal(19,0)") + F.col("low").cast("decimal(19,0)")).cast("decimal(38,0)")
    long = white.select("id", deviation.alias("deviation"), F.posexplode("white").alias("k", "whitened"))
    return long.select(
        F.col("id").alias(id_column),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"),
        F.lit(float(row["worst"])).alias("identity_error"),
    )
