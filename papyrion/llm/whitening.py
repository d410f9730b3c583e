"""Whitening of embeddings with a covariance recovered from variances alone.

An entry c becomes the whole number x = floor(256 * c). The fit list has each distinct vector x once;
it is made by grouping on the vectors themselves, in a compact form that is combined before
the shuffle, and is written to the shared folder.

Covariances come by polarisation: a pass over the fit list sums, for each dimension i and each
pair i < j, the squares of the centred values of x_i and of x_i + x_j. Twice the covariance of a
pair is the variance of its sum less the variances of its two dimensions. Values are centred on the
whole number c below the mean, whose distance to the mean is known exactly: with t = x - c and n
vectors whose t sum to r, the squares of n * t - r sum to n * (n * sum(t ** 2) - r ** 2). So all
sums are of small whole numbers, the rest is done in integers of any size, and each covariance
is rounded once, to a double. The matrix goes to eigh on the driver.

A task of the pass gives one number for each dimension and pair, (d + 1) * d / 2 of them; only sums
over tasks come to the driver. The width d is bounded by `MOST_DIMS`.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite (or too
large for x to be a long), are dropped; so are vectors of another length than most rows have (of
equally frequent lengths, the greatest counts) and empty vectors. A null id stays null; repeated rows are
answered one by one, and count once in the fit. A direction in which the fit list does not
vary cannot be whitened and is no component, so fewer than the components asked for may come; a
single distinct vector has none. Extra columns are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.session import stage

SCALE = 256
COMPONENTS = 4
#: The widest vectors that are taken: the driver gets a number for each pair of dimensions.
MOST_DIMS = 4096
#: Vectors whose squares are summed at once.
ROWS = 1024
#: A direction with less than this share of the whole variance does not vary.
LEAST_SHARE = 1e-13


def _whole(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that remain, and their vectors x; ``dims`` None: of all rows that have a vector, their lengths instead."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    if dims is None:
        return np.flatnonzero(sizes >= 0), sizes[sizes >= 0]
    rows = np.flatnonzero(sizes == dims)
    values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # null entries are NaN
    scaled = np.floor(values * SCALE)
    good = (np.abs(scaled) < 2.0**62).all(axis=1)
    return rows[good], scaled[good].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest whole numbers that hold it, after their width: equal vectors, and only they, have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    least, most = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        limit = 1 << (8 * w - 1)
        width[(least >= -limit) & (most < limit)] = w
    for w in (1, 2, 4, 8):
        for k in np.flatnonzero(width == w).tolist():
            out[k] = bytes([w]) + x[k].astype(f"<i{w}").tobytes()
    return out


def _unpacked(packed: pa.Array, dims: int) -> np.ndarray:
    raws = packed.to_pylist()
    x = np.empty((len(raws), dims), np.int64)
    widths = np.array([raw[0] for raw in raws])
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        x[rows] = np.frombuffer(b"".join([raws[k][1:] for k in rows.tolist()]), f"<i{w}").reshape(len(rows), dims)
    return x


def _sums(dims: int):
    """One row for each dimension: the number of vectors, and the sum of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            n += len(x)
            # In two halves, so that no sum leaves 64 bits.
            high, low = (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 31) + l for t, h, l in zip(total, high, low)]
        yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "n": [n] * dims, "s": [str(t) for t in total]}, _SUMS)

    return run


_SUMS = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())])
_SQUARES = pa.schema([("k", pa.int32()), ("q", pa.string())])


def _squares(dims: int, centre: list[int]):
    """One row for each dimension, then for each pair i < j in order: the sum of squares of the centred values."""
    at = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims * (dims + 1) // 2)
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            for low in range(0, len(x), ROWS):
                wide = [v - c for v, c in zip((x[low : low + ROWS]).T.astype(object), centre)] if _far(x, at) else None
                t = np.array(wide, object) if wide else np.ascontiguousarray((x[low : low + ROWS] - at).T, np.float64)
                # Whole numbers of this size and number add up exactly in doubles; larger ones in Python's integers.
                if wide is None and 4.0 * float(np.abs(t).max(initial=0)) ** 2 * ROWS >= 2.0**53:
                    t = t.astype(np.int64).astype(object)
                square = (lambda u: (u * u).sum(axis=-1)) if t.dtype == object else (lambda u: np.einsum("ij,ij->i", u, u))
                found = [square(t)] + [square(t[i + 1 :] + t[i]) for i in range(dims - 1)]
                total = [s + int(q) for s, q in zip(total, np.concatenate(found).tolist())]
        yield pa.RecordBatch.from_pydict({"k": list(range(len(total))), "q": [str(s) for s in total]}, _SQUARES)

    return run


def _far(x: np.ndarray, at: np.ndarray) -> bool:
    """Are differences too large for doubles to hold exactly?"""
    return max(int(np.abs(x).max(initial=0)), int(np.abs(at).max(initial=0))) >= 1 << 51


@dataclass(frozen=True)
class Fit:
    """What the rows are whitened with; ``centre`` and ``rest`` give the mean as centre + rest / n, exactly."""

    n: int
    centre: list[int]
    rest: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, in doubles."""
        return (x - np.array(self.centre, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.from_mean(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S) ** 2, exactly."""
        t = x - np.array(self.centre, np.int64)
        reach = int(np.abs(t).max(initial=0)) * self.n + self.n
        if reach**2 * x.shape[1] < 1 << 63:
            y = self.n * t - np.array(self.rest, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        wide = [self.n * v.astype(object) - r for v, r in zip(t.T, self.rest)]
        return sum(y * y for y in wide).tolist()


def fit_list(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The distinct vectors x, one packed value a row and written, and their length."""
    column = F.col(f"`{vector}`").cast("array<double>")
    sizes = rows.where(column.isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"] or 0
    if most > MOST_DIMS:
        raise ValueError(f"vectors of {most} dimensions; at most {MOST_DIMS} are taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # What repeats in a batch goes on once.
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(_packed(_whole(batch.column(0), most)[1]))), pa.binary())], ["x"])

    packed = rows.select(column.alias("v")).where(F.size("v") == F.lit(most) if most else F.lit(False))
    return stage(packed.mapInArrow(run, "x binary").distinct(), "whitening-fit"), most


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Fit | None:
    """Mean, covariance and components of a fit list, as `fit_list` gives it; None if it is empty."""
    exact = T.DecimalType(38, 0)
    sums = distinct.mapInArrow(_sums(dims), "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s"))
    found = sorted(sums.collect()) if dims else []
    if not found or not found[0]["n"]:
        return None
    n = found[0]["n"]
    centre = [int(row["s"]) // n for row in found]
    rest = [int(row["s"]) % n for row in found]
    squares = distinct.mapInArrow(_squares(dims, centre), "k int, q string").groupBy("k").agg(F.sum(F.col("q").cast(exact)).alias("q"))
    q = dict(map(tuple, squares.collect()))
    variance, k = [[0] * dims for _ in range(dims)], dims
    # n ** 3 times the variance of each dimension, and of each sum of two.
    alone = [n * (n * int(q[i]) - rest[i] ** 2) for i in range(dims)]
    for i in range(dims):
        variance[i][i] = alone[i] / n**3
        for j in range(i + 1, dims):
            both = n * (n * int(q[k]) - (rest[i] + rest[j]) ** 2)
            variance[i][j] = variance[j][i] = (both - alone[i] - alone[j]) / (2 * n**3)
            k += 1
    matrix = np.array(variance)
    values, vectors = np.linalg.eigh(matrix)
    trace = sum(alone) / n**3
    order = [int(i) for i in np.argsort(-values, kind="stable") if values[i] > LEAST_SHARE * trace][:components]
    # The sign is free; the largest entry is made positive, so that runs agree.
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))]) if order else np.empty(0)
    return Fit(n, centre, rest, matrix, values[order], chosen * signs, trace)


def identity_error(distinct: DataFrame, dims: int, found: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity, as measured over the list."""
    m = len(found.values)
    shape = "k int, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m + m * m)
        for batch in batches:
            w = found.whiten(_unpacked(batch.column(0), dims))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"k": list(range(len(total))), "v": total.tolist()}, pa.schema([("k", pa.int32()), ("v", pa.float64())]))

    if not m:
        return 0.0
    parts = distinct.mapInArrow(run, shape).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    mean, second = np.array([p["v"] for p in parts[:m]]) / found.n, np.array([p["v"] for p in parts[m:]]).reshape(m, m) / found.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row that remains and each component.

    ``deviation`` is a decimal of 38 digits, since it may exceed a long.
    """
    distinct, dims = fit_list(rows, vector)
    found = fit(distinct, dims, components)
    chosen = rows.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{vector}`").cast("array<double>").alias("__vector"))
    fields = T.StructType.fromDDL("component int, n long, deviation string, whitened double, explained double, identity_error double")
    shape = T.StructType([chosen.schema["__key"], *fields.fields])
    error = identity_error(distinct, dims, found) if found else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(found.values)
        share = [float(e / found.trace) for e in found.values]
        for batch in batches:
            at, x = _whole(batch.column(1), dims)
            rows, size = len(at), len(at) * m
            if not size:
                continue
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                pa.array(np.full(size, found.n, np.int64)),
                pa.array([str(d) for d in found.deviation(x) for _ in range(m)], pa.string()),
                pa.array(found.whiten(x).ravel()),
                pa.array(share * rows, pa.float64()),
                pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["__key", *fields.names])

    there = chosen.where(F.size("__vector") == dims) if found and len(found.values) else chosen.where(F.lit(False))
    made = there.mapInArrow(run, shape)
    return made.withColumn("deviation", F.col("deviation").cast(T.DecimalType(38, 0))).withColumnRenamed("__key", key)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    made = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return made.withColumn("deviation", F.col("deviation").cast("long"))
