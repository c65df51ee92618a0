"""Whitening of embeddings from an exact integer scatter.

Entries become integers, x = floor(SCALE * c) + OFFSET. Each distinct x vector counts once (the fit list). Tasks subtract a
shift and sum the rest and its cross-products exactly: the integers are cut into limbs of 20 bits whose products a float
matrix product sums without rounding over 4096 rows, and those sums are added up as integers of any size. Spark adds up
the tasks' sums by (i, j, limb of 30 bits). The driver forms n XᵀX - SSᵀ from integers of any size; only then come floats,
divided by n² with one rounding each, and eigh. Rows are centred as the integers n x - S before they are projected.

Sizes: a task sends d (d + 3) / 2 sums, whatever it has read, and the driver gets as many; d is MAX_DIM at most, which is
checked. Broadcast are 16 components of d entries. Copies of a vector meet in a partial aggregation first.

Cases: rows whose vector is null, empty or holds null or non-finite entries are left out; so are vectors of other lengths
than most distinct vectors have (of ties the longest), as they lie in no common space; x is bound to the range of long; a
component whose e is 0 but for rounding has no whitened value (null) and takes no part in identity_error (0 when none
does); with one distinct vector e and the deviation are 0 and explained is null; a deviation beyond 38 digits is null;
repeated rows and null ids are returned each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, written

SCALE, OFFSET = 64, 1_000_000
MAX_DIM = 4096
LIMB, ROWS, PLACE = 20, 4096, 30
LONG_MAX = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): the rows with whole finite vectors, as integers."""
    v = F.col("v")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(v.isNotNull() & (F.size(v) > 0)).filter(~odd)
    x = F.transform(v, lambda c: F.least(F.floor(c * SCALE).cast("long"), F.lit(LONG_MAX - OFFSET)) + OFFSET)
    return rows.select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(-1, dim)


def shifted(x: np.ndarray, shift: int) -> np.ndarray:
    """x - shift: longs where they hold it, else Python's integers."""
    return x - shift if x.size == 0 or (x.min() > -(2**62) and x.max() < 2**62 and abs(shift) < 2**62) else x.astype(object) - shift


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as the sum of limb_k * 2**(LIMB * k), each limb between -2**19 and 2**19, as exact floats."""
    half, out = 1 << (LIMB - 1), []
    while True:
        low = (y + half) % (1 << LIMB) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not y.any():
            return out


class Scatter:
    """Exact n, sums and cross-products of integer rows; what is held grows with the dimension alone."""

    def __init__(self, dim: int):
        self.n, self.sums, self.cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            parts = limbs(y[at : at + ROWS])
            self.n += len(parts[0])
            for i, a in enumerate(parts):
                self.sums += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
                for j, b in enumerate(parts[: i + 1]):
                    product = (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
                    self.cross += product if i == j else product + product.T

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(i, j, place, value): n at (-1, -1), sums at (-1, j), cross-products at (i, j) for i <= j."""
        found = [(-1, -1, self.n), *((-1, j, s) for j, s in enumerate(self.sums)), *((i, j, self.cross[i, j]) for i in range(len(self.sums)) for j in range(i, len(self.sums)))]
        out = []
        for i, j, v in found:
            sign, v, place = (-1, -v, 0) if v < 0 else (1, v, 0)
            while v:
                out.append((i, j, place, sign * (v & ((1 << PLACE) - 1))))
                v, place = v >> PLACE, place + 1
        return out


def scatter(fit: DataFrame, dim: int, shift: int) -> Scatter:
    """The exact sums of all rows of x - shift: each task's, then Spark's over all tasks by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(dim)
        for batch in batches:
            own.add(shifted(matrix(batch.column("x"), dim), shift))
        i, j, place, value = (list(c) for c in zip(*own.rows(), strict=True)) if own.n else ([], [], [], [])
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(value, pa.int64())})

    sums = fit.select("x").mapInArrow(partial, "i int, j int, place int, value long").groupBy("i", "j", "place").agg(F.sum("value").alias("value"))
    out, rows = Scatter(dim), sums.toArrow().to_pydict()
    for i, j, place, value in zip(*(rows[k] for k in ("i", "j", "place", "value")), strict=True):
        v = value << (PLACE * place)
        if i < 0 and j < 0:
            out.n += v
        elif i < 0:
            out.sums[j] += v
        else:
            out.cross[i, j] += v
            out.cross[j, i] = out.cross[i, j]
    return out


@dataclass
class Whitening:
    """Components by falling eigenvalue; ``sums`` are those of x, unshifted."""

    dim: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums)) if x.size else 0
        return x * self.n - self.sums.astype(np.int64) if most < 2**62 else x.astype(object) * self.n - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows of values, nan for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred.astype(np.float64) / self.n) @ self.components / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def fit_whitening(fit: DataFrame, dim: int, components: int = 16, shift: int = OFFSET) -> Whitening:
    found = scatter(fit, dim, shift)
    n, y = found.n, found.sums
    # the covariance does not change with the shift: n * sum(y yT) - sum(y) sum(y)T over integers, then one rounding each
    exact = n * found.cross - np.outer(y, y)
    e, q = np.linalg.eigh((exact / (n * n)).astype(float))
    k = min(components, dim)
    e, q = e[::-1][:k].copy(), q[:, ::-1][:, :k].copy()
    trace = sum(exact[i, i] for i in range(dim)) / (n * n)
    e[e <= dim * np.finfo(float).eps * max(e.max(), 0.0)] = 0.0
    return Whitening(dim, n, y + n * shift, e, q, [x / trace if trace else None for x in e])


def squares(c: np.ndarray) -> list[int]:
    """Each row's sum of squares, exactly."""
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 2**62:
        return (c * c).sum(axis=1).tolist()
    return [sum(a * a for a in r) for r in c.tolist()]


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened rows."""
    live = w.values > 0
    k = int(live.sum())
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = w.whitened(w.centred(matrix(batch.column("x"), w.dim)))[:, live]
            sums, cross = sums + z.sum(axis=0), cross + z.T @ z
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(k + k * k), pa.int32()), "value": pa.array(np.r_[sums, cross.ravel()])})

    rows = fit.select("x").mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    found = np.zeros(k + k * k)
    found[rows["at"]] = rows["value"]
    mean = found[:k] / w.n
    return float(np.abs(found[k:].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of every whole vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_rows = integers(vectors, id_col, vec_col)
    fit = written(all_rows.select("x").distinct(), "fit_list")
    size = fit.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size.dim
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries: the scatter of more than {MAX_DIM} does not fit one machine")
    alike = F.size("x") == dim
    w = fit_whitening(fit.filter(alike), dim, components)
    error, k = identity_error(fit.filter(alike), w), len(w.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            c = w.centred(matrix(batch.column("x"), w.dim))
            z = w.whitened(c).ravel()
            deviation = pa.array([s if s < 10**38 else None for s in squares(c)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, w.n), pa.int64()),
                    "deviation": deviation.take(each),
                    "whitened": pa.array(z, mask=np.isnan(z)),
                    "explained": pa.array(w.explained * m, pa.float64()),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return all_rows.filter(alike).mapInArrow(rows, schema)


def op11_whitening(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """A deviation beyond the range of long is null; ``whiten`` itself gives 38 digits."""
    out = whiten(vectors)
    return out.withColumns({"vec_id": F.col("vec_id").cast("long"), "deviation": F.expr("try_cast(deviation AS BIGINT)")})
