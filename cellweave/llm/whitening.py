"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Vectors of integers are centred by the integers nearest to their means. Each partition multiplies their residues modulo several
primes below 2**20 as float64 matrices, of so few rows that no sum reaches 2**53; bands of the products are added up modulo
their prime in two hops, and the Chinese remainder theorem turns them into the exact scatter. What the centring left over is
taken out in integers, and the exact covariance, rounded once, goes to a double eigendecomposition. What reaches the driver is
of the size of the dimensions, never of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
#: Rows of one product: 2**13 * (2**20)**2 is 2**53.
GEMM_ROWS = 1 << 13
PRIME_BELOW = 1 << 20
#: Rows of the scatter matrix that travel together, and lanes of partitions that are added up apart first.
BAND, LANES = 64, 64
#: Entries from here on, in absolute value, have no long after scaling.
TOO_LARGE = 2.0**61


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_BELOW, as many as make the product larger than asked."""
    out, total, p = [], 1, PRIME_BELOW - 1
    while total <= product:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            total *= p
        p -= 2
    return out


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as an integer matrix) for each length of vector in the column; unusable rows are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    none = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
        bad = none | ~np.isfinite(values) | ~(np.abs(scaled) < TOO_LARGE)
    end = np.cumsum(sizes)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        at = (end[rows] - d)[:, None] + np.arange(d)
        ok = ~bad[at].any(axis=1)
        if ok.any():
            yield rows[ok], scaled[at[ok]].astype(np.int64) + SHIFT


def sums(df: DataFrame, vector_col: str) -> list:
    """(dim, n, S, least, most) of each dimension, over the vectors of the commonest length (of equals the longest)."""
    ddl = "length int, dim int, n long, lo long, hi long, least long, most long"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                new = [len(x), (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                if old := held.get(x.shape[1]):
                    new = [*(a + b for a, b in zip(old[:3], new)), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
                held[x.shape[1]] = new
        for d, (n, *rest) in held.items():
            yield common.record_batch([(d, k, n, *row) for k, row in enumerate(zip(*(x.tolist() for x in rest)))], schema)

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = df.select(F.col(vector_col)).mapInArrow(run, ddl).groupBy("length", "dim").agg(F.sum("n").alias("n"), total("lo"), total("hi"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = common.store(found, "sums")
    top = found.orderBy(F.desc("n"), F.desc("length")).first()
    if not top:
        return []
    rows = found.where(F.col("length") == top["length"]).orderBy("dim").collect()
    return [(r["dim"], r["n"], int(r["lo"]) + (int(r["hi"]) << 32), r["least"], r["most"]) for r in rows]


def _added(parts: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Bands with equal keys added up modulo their prime, as a stream of one key after the other."""
    ddl = ", ".join(f"{k} int" for k in keys) + ", data binary"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for *k, data in zip(*(c.to_pylist() for c in batch.columns)):
                band = np.frombuffer(data, "<i4").astype(np.int64)
                if k != key:
                    if key:
                        yield common.record_batch([(*key, total.astype("<i4").tobytes())], schema)
                    key, total = k, band
                else:
                    total = (total + band) % k[0]
        if key:
            yield common.record_batch([(*key, total.astype("<i4").tobytes())], schema)

    return parts.select(*keys, "data").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def scatter(df: DataFrame, vector_col: str, centre: np.ndarray, bound: int) -> np.ndarray:
    """The exact sums of z zᵀ as Python integers, z = x - centre; bound: no entry's absolute value is larger."""
    d, moduli = len(centre), primes(2 * bound + 1)
    ddl = "prime int, band int, lane int, data binary"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), d, d), np.int64)
        used = False
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                if x.shape[1] == d:
                    used, z = True, x - centre
                    for at in range(0, len(z), GEMM_ROWS):
                        for k, p in enumerate(moduli):
                            r = (z[at : at + GEMM_ROWS] % p).astype(np.float64)
                            total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        if used:
            lane = TaskContext.get().partitionId() % LANES
            for k, p in enumerate(moduli):
                for b in range(0, d, BAND):
                    yield common.record_batch([(p, b, lane, total[k, b : b + BAND].astype("<i4").tobytes())], schema)

    parts = _added(_added(df.select(F.col(vector_col)).mapInArrow(run, ddl), ["prime", "band", "lane"], d), ["prime", "band"], d)
    product = math.prod(moduli)
    out = np.zeros((d, d), object)
    for p, b, data in parts.collect():
        rest = product // p
        out[b : b + BAND] += np.frombuffer(data, "<i4").reshape(-1, d).astype(object) * (rest * pow(rest, -1, p))
    out %= product
    return np.where(out > product // 2, out - product, out)


class Model(NamedTuple):
    """n vectors with sums S (integers) and entries within `reach` of their means; component vectors as columns, and eigenvalues."""

    n: int
    total: list[int]
    reach: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> list[np.ndarray]:
        """n x - S, exactly: one array of longs or, where they do not fit, one of Python integers."""
        total = self.total
        if self.n * self.reach < 1 << 62 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            return x * self.n - np.array(total, np.int64)
        return x.astype(object) * self.n - np.array(total, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """y: deviations. NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((y / self.n).astype(np.float64) @ self.vectors) / np.sqrt(self.values)
        out[:, ~(self.values > 0)] = np.nan
        return out


def squares(y: np.ndarray) -> list[int]:
    """Sums over the columns of y**2, exactly: in limbs of 21 bits, whose products' sums fit in longs."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    if y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    limbs = [y & 0x1FFFFF, (y >> 21) & 0x1FFFFF, y >> 42]
    out = [0] * len(y)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out = [o + (s << 21 * (i + j)) for o, s in zip(out, (a * b).sum(axis=1).tolist())]
    return out


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 8) -> Model | None:
    """Components of the vectors' exact covariance (divisor n), by falling eigenvalue; None without a vector.

    A component whose eigenvalue is within rounding of zero has the value 0. Signs: the largest entry is positive.
    """
    stats = sums(df, vector_col)
    if not stats:
        return None
    n, total = stats[0][1], [s[2] for s in stats]
    centre = [(2 * s + n) // (2 * n) for s in total]
    reach = max(max(abs(lo - c), abs(hi - c)) for (_, _, _, lo, hi), c in zip(stats, centre)) + 1
    z = scatter(df, vector_col, np.array(centre, np.int64), n * reach * reach)
    rest = np.array([s - n * c for s, c in zip(total, centre)], object)
    exact = z * n - np.outer(rest, rest)
    v = np.array([[c / (n * n) for c in row] for row in exact.tolist()])
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    values, vectors_ = values[order], vectors_[:, order]
    vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    values = np.where(values > len(v) * np.finfo(float).eps * max(values[0], 0), values, 0)
    return Model(n, total, reach, vectors_, values, sum(exact[i, i] for i in range(len(v))) / (n * n))


def identity_error(df: DataFrame, vector_col: str, model: Model) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, centred in each batch before multiplying."""
    d, good = len(model.total), model.values > 0
    k = int(good.sum())
    if not k:
        return None

    def merged(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def row(state: tuple, lane: int) -> pa.RecordBatch:
        return common.record_batch([(lane, state[0], state[1].tobytes(), state[2].tobytes())], schema)

    ddl = "lane int, n long, mean binary, square binary"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                if x.shape[1] == d:
                    w = model.whitened(model.deviations(x))[:, good]
                    mean = w.mean(axis=0)
                    new = (len(w), mean, (w - mean).T @ (w - mean))
                    state = merged(state, new) if state else new
        if state:
            yield row(state, TaskContext.get().partitionId() % LANES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for r in batch.to_pylist():
                new = _state(r, k)
                state = merged(state, new) if state else new
        if state:
            yield row(state, 0)

    state = None
    for r in df.select(F.col(vector_col)).mapInArrow(run, ddl).repartition(LANES, "lane").sortWithinPartitions("lane", "n", "mean").mapInArrow(join, ddl).collect():
        new = _state(r.asDict(), k)
        state = merged(state, new) if state else new
    return float(np.abs(state[2] / state[0] - np.eye(k)).max())


def _state(r: dict, k: int) -> tuple:
    return r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]).reshape(k, k)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component.

    An entry c becomes floor(1024 c) + 100000. Vectors that are null or empty, that hold null or non-finite entries or such
    as no long can hold, and those of another length than the commonest (of equals the longest) are left out. deviation is a
    decimal(38,0), null beyond it. Repeated rows and ids stay, a null id stays null. A component without variance (all of
    them if the vectors are equal) has whitened null, and identity_error is over the others, null if there are none. Other
    columns are not read. A table without a vector gives no rows.
    """
    ddl = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(df, vector_col, components)
    slim = df.select(F.col(vector_col).alias("x"), F.col(id_col).cast("long").alias("vec_id"))
    if model is None:
        return df.sparkSession.createDataFrame([], ddl)
    error, m, d = identity_error(df, vector_col, model), len(model.values), len(model.total)
    explained = model.values / model.trace if model.trace > 0 else np.full(m, np.nan)
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors(batch.column(0)):
                if x.shape[1] != d:
                    continue
                y = model.deviations(x)
                far = [s if s < 10**38 else None for s in squares(y)]
                w = model.whitened(y).ravel()
                each = np.repeat(np.arange(len(rows)), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(rows)).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(each), model.n, np.int64)),
                        pa.array(far, kind).take(pa.array(each)),
                        pa.array(w, pa.float64(), from_pandas=True),
                        pa.array(np.tile(explained, len(rows)), pa.float64(), from_pandas=True),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return slim.mapInArrow(run, ddl)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is a long here, null where it does not fit."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
