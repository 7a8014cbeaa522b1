"""Embedding whitening by matrix-free block subspace iteration.

1. Vectors with null or non-finite entries go; entries become integers (fixed point, STEP to one). Each distinct vector is fitted once, so
   copies have no weight; a distinct aggregation combines before its shuffle.
2. A pass gives the number of vectors and the exact sums per dimension. Each later pass gives X'(XQ) of the centred rows for a block
   Q of orthonormal columns: a task adds its rows' part, and parts are added in Spark, so the driver gets a matrix of dimensions by
   block width and never the covariance, which is nowhere made.
3. The driver takes the Rayleigh-Ritz vectors of the block, and the product's QR is the next block. It ends when every wanted
   component's residual, against its distance to the nearest other eigenvalue, certifies it to double precision (or is itself at the
   limit of rounding). Where convergence is slow (close eigenvalues), the block is widened by the product's directions; as wide as the
   space has dimensions, its Ritz vectors are exact.
4. All rows, copies too, are projected; a last pass over the fitted vectors measures the whitened covariance.

Defined cases: the vector's length is the longest one's, and shorter ones count as if zeros followed; entries too large for a 64-bit
integer are cut to the nearest that fits; directions without variance are no components, so there may be fewer than asked for, and
none, so no rows, of one distinct vector; deviation is null where it exceeds a long; null ids and repeated rows stay; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

STEP = 256
#: Columns of the first block besides the wanted ones.
MORE = 12
#: A component is certified by a residual of this share of its eigenvalue's distance to others, or of ROUNDING of the largest eigenvalue.
CLOSE, ROUNDING = 1e-11, 2e-15
#: Eigenvalues under this share of the largest are taken as zero: rounding alone gives as much.
NOTHING = 1e-12
#: The widest block; beyond it, iteration goes on at that width.
WIDEST = 1024
#: A residual that a pass leaves at more than this share has the block widened; so many passes are an error.
SLOW, PASSES = 0.03, 5000
#: Entries of rows that a task turns into a matrix at once.
ENTRIES = 4_000_000


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    #: Dimensions by components, and the components' eigenvalues, by falling eigenvalue.
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def fixed(vector: Column, step: int = STEP) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * step).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: bad(c.cast("double")))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their vectors as rows of a matrix of integers, with zeros after shorter ones."""
    rows = max(1, ENTRIES // max(1, dims))
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            lists = part.column(column)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) == part.num_rows * dims:
                yield part, flat.reshape(-1, dims)
                continue
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            full = np.zeros((part.num_rows, dims), np.int64)
            full[np.arange(dims)[None, :] < sizes[:, None]] = flat
            yield part, full


def _added(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of of(matrix) over all rows, a matrix of fixed shape: one line a task and row of it, added in Spark."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "x", dims):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    value = F.col("v").cast("decimal(20,0)") if kind == "long" else F.col("v")
    added = rows.select("x").mapInArrow(parts, f"i long, v {kind}").groupBy("i").agg(F.sum(value).alias("v"))
    # As many rows as the result has numbers, whatever the number of vectors.
    found = added.toPandas().sort_values("i")
    return found["v"].to_numpy()


def _certified(values: np.ndarray, residuals: np.ndarray, k: int) -> np.ndarray:
    """Whether each of the first k Ritz pairs is certified. Eigenvalues closer than rounding tells apart span one space, whose basis is free."""
    near = [min((abs(values[i] - v) for j, v in enumerate(values) if j != i), default=values[0]) for i in range(k)]
    return np.array([residuals[i] <= max(CLOSE * near[i], ROUNDING * values[0] * np.sqrt(len(values))) for i in range(k)])


def fit(rows: DataFrame, k: int) -> tuple[Whitening | None, DataFrame]:
    """rows: x array<long>, one row of each vector. Returns the whitening of the first k components (None if there are none) and the rows, staged."""
    rows = staged(rows.select("x"), "whitening-vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if n < 2 or not dims:
        return None, rows
    sums = _exact_sums(rows, dims)
    mean = np.array([s / n for s in sums])
    width, passes = min(dims, k + MORE), 0
    q = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, width)))[0]
    before = 0.0
    while True:
        width = q.shape[1]

        # Centred rows: the sum of squares is added in the last row's first place.
        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = x - mean
            return np.vstack([c.T @ (c @ q), np.pad([np.einsum("ij,ij", c, c)], (0, q.shape[1] - 1))])

        found = _added(rows, dims, product, "double").reshape(dims + 1, width) / n
        y, trace, passes = found[:-1], float(found[-1, 0]), passes + 1
        values, turn = np.linalg.eigh((small := q.T @ y) / 2 + small.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residuals = np.linalg.norm(y @ turn - vectors * values, axis=0)
        there = int((values[:k] > NOTHING * max(values[0], 0)).sum())
        rate, before = residuals[:k].max() / before if before else 0.0, residuals[:k].max()
        widest = width >= min(dims, WIDEST)
        # After a second pass, Ritz values of nothing tell that all directions with variance are in the block.
        whole = there == min(k, dims) or passes > 1 and residuals[there:k].max() <= NOTHING * values[0]
        limit = widest and rate > 0.9 and before <= CLOSE * values[0]  # rounding lets it fall no further
        if width == dims or whole and (limit or _certified(values, residuals, there).all()):
            return (Whitening(n, sums, vectors[:, :there], values[:there], trace, passes) if there else None), rows
        if passes == PASSES:
            raise ArithmeticError(f"residuals of {before / values[0]:.1e} of the largest eigenvalue after {passes} passes")
        q = np.linalg.qr(np.hstack([vectors, y @ turn]) if rate > SLOW and not widest else y @ turn)[0][:, : max(WIDEST, width)]


def _exact_sums(rows: DataFrame, dims: int) -> list[int]:
    """Sums per dimension; high and low halves are added apart, so that no task's and no total sum overflows."""
    halves = _added(rows, dims, lambda x: np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long").reshape(2, dims)
    return [(int(high) << 32) + int(low) for high, low in halves.T]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - S) squared, exact; None beyond a long."""
    reach = n * max(1, -int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if reach * reach * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]


def identity_error(model: Whitening, rows: DataFrame) -> float:
    """Largest entry of |covariance of the whitened rows - identity|."""
    k, dims = model.vectors.shape[1], model.vectors.shape[0]

    def product(x: np.ndarray) -> np.ndarray:
        z = model(x)
        return np.vstack([z.sum(axis=0), z.T @ z])

    found = _added(rows, dims, product, "double").reshape(k + 1, k) / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows: vec_id, x. A row per vector and component: vec_id, component (from 1), deviation, whitened."""
    k, dims = model.vectors.shape[1], model.vectors.shape[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "x", dims):
            z = model(x)
            at = np.repeat(np.arange(len(x)), k)
            away = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), away.take(at), pa.array(z.reshape(-1))], names=["vec_id", "component", "deviation", "whitened"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(of, "vec_id long, component int, deviation long, whitened double")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", fixed(F.col("embedding")).alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))))
    model, fitted = fit(padded.select("x").distinct(), 4)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(model, fitted)
    explained = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.values)), F.col("component"))
    return whiten(padded, model).select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
