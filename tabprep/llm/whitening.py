"""Whitening of embeddings onto their leading principal components, fitted on all vectors with exact sums."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.spectrum import Eigenpairs, leading_eigenpairs

#: Entries become ``floor(SCALE * c) + SHIFT``; beyond ``LIMIT`` in size an entry counts as not finite.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**52
#: Entries of a block that numpy works on at once.
BLOCK_ENTRIES = 1 << 20


def _blocks(column: pa.Array, size: int | None = None):
    """Yield (row numbers, matrix of longs) of the usable vectors in blocks of rows of one size (or of ``size``)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = np.floor(SCALE * pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore"):
        fine = np.abs(entries) < LIMIT  # null entries are NaN here
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    wrong = np.concatenate([[0], np.cumsum(~fine)])
    usable = (lengths > 0) & (wrong[ends] == wrong[starts])
    for d in np.unique(lengths[usable]):
        if size is not None and d != size:
            continue
        rows = np.flatnonzero(usable & (lengths == d))
        step = max(1, BLOCK_ENTRIES // int(d))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield some, entries[starts[some][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def _exact_product(y: np.ndarray) -> np.ndarray:
    """yᵀy as Python integers; by floating point where every partial sum is below 2**53, so exact as well."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


@dataclass(frozen=True)
class Whitening:
    """Sums of the fit list and its leading components.

    ``centre`` is the integer next to each mean; ``rest`` is the mean's remainder, so ``x - mean = (x - centre) - rest``
    loses nothing to the large common shift.
    """

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    rest: np.ndarray
    pairs: Eigenpairs
    trace: float

    @property
    def axes(self) -> np.ndarray:
        return self.pairs.vectors / np.sqrt(self.pairs.values)[:, None]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.axes.T

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sum)**2, exact; null where it does not fit a long."""
        y, off = x - self.centre, [s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)]
        largest = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, off), default=0)
        if largest * largest * x.shape[1] < 1 << 63:
            t = self.n * y - np.array(off, np.int64)
            return pa.array((t * t).sum(1))
        t = self.n * y.astype(object) - np.array(off, object)
        return pa.array([v if v < 1 << 63 else None for v in (t * t).sum(1)], pa.int64())


def _vectors(vectors: DataFrame, embedding: str) -> DataFrame:
    return vectors.select(F.col(embedding).cast("array<double>").alias("v"))


def _totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and sums of the vectors of the most frequent size (of the largest such size)."""

    def run(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                part = x.astype(object).sum(0) if len(x) > 1024 and np.abs(x).max() > 1 << 40 else x.sum(0).astype(object)
                n, total = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = n + len(x), total + part
        for d, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict({
                "d": pa.array([d] * (d + 1), pa.int32()), "i": pa.array(range(-1, d), pa.int32()),
                "total": pa.array([n, *total.tolist()], pa.decimal128(38, 0)),
            })

    summed = vectors.mapInArrow(run, "d int, i int, total decimal(38,0)").groupBy("d", "i").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    size = summed.filter("i = -1").orderBy(F.desc("total"), F.desc("d")).first()
    if size is None:
        return 0, []
    rows = summed.filter(F.col("d") == size["d"]).orderBy("i").collect()  # one row per dimension
    return int(rows[0]["total"]), [int(r["total"]) for r in rows[1:]]


def _products(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Exact sums of (x - centre)(x - centre)ᵀ over all vectors; tasks send the upper triangle of their own sums."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches):
        total, seen = np.zeros((d, d), object), False
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                total, seen = total + _exact_product(x - centre), True
        if seen:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()),
                "total": pa.array(total[upper].tolist(), pa.decimal128(38, 0)),
            })

    summed = vectors.mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((d, d), object)
    for i, j, total in summed.collect():  # d * (d + 1) / 2 rows, however many vectors there are
        out[i, j] = out[j, i] = int(total)
    return out


def fit(vectors: DataFrame, components: int = 8, embedding: str = "embedding") -> Whitening | None:
    """Fit on all vectors without null or non-finite entries; None where there are none.

    The covariance (divisor n) is exact up to its last rounding: sums of integers centred on the integer next to the
    mean, corrected by the remainder. Vectors of another size than the most frequent one (the larger of two) take no
    part, nor do empty ones. Directions in which the vectors do not vary are no components, so equal vectors have none.
    """
    usable = _vectors(vectors, embedding)
    n, sums = _totals(usable)
    if not n:
        return None
    centre = [round(Fraction(s, n)) for s in sums]
    off = np.array([s - n * m for s, m in zip(sums, centre, strict=True)], object)
    exact = n * _products(usable, np.array(centre, np.int64)) - np.outer(off, off)
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in exact]).reshape(len(sums), len(sums))
    pairs = leading_eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    varies = pairs.values > 16 * len(sums) * np.finfo(float).eps * trace
    pairs = Eigenpairs(pairs.values[varies], pairs.vectors[varies], pairs.certified[varies])
    rest = np.array([float(Fraction(int(o), n)) for o in off])
    return Whitening(n, tuple(sums), np.array(centre, np.int64), rest, pairs, trace)


def identity_error(vectors: DataFrame, plan: Whitening, embedding: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k, d = len(plan.pairs.values), len(plan.sums)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _blocks(batch.column(0), d):
                w = plan.whitened(x)
                total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range((k + 1) * k), pa.int32()), "total": pa.array(total.ravel())})

    if not k:
        return 0.0
    rows = _vectors(vectors, embedding).mapInArrow(run, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros((k + 1) * k)
    for i, total in rows:
        flat[i] = total / plan.n
    mean, product = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    ``whitened`` is the centred vector projected on the component over the root of its variance, ``explained`` the
    component's share of all variance, ``deviation`` n² times the squared distance to the mean, exact (null where it does
    not fit a long), ``identity_error`` one value for the whole table. Null vectors and those with null or non-finite
    entries have no rows; a null or repeated id keeps a row for each vector. An empty table gives no rows. Other columns
    of the table are not read, whatever their names.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    plan = fit(vectors, components, embedding)
    if plan is None or not len(plan.pairs.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, plan, embedding)
    k, d = len(plan.pairs.values), len(plan.sums)
    explained = plan.pairs.values / plan.trace

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, x in _blocks(batch.column(1), d):
                repeated = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)).take(repeated),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * k, plan.n)),
                    plan.deviations(x).take(repeated),
                    pa.array(plan.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(rows) * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, schema)
