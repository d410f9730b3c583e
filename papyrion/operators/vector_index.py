"""An index of vectors by cells, for nearest neighbours without comparing everything.

Building: centres of cells are fitted by k-means on a bounded sample (`FIT_ROWS` a cell, chosen by
a hash of the id) in rounds of one pass each, in which tasks hand on sums by cell. Then every
vector is put into its nearest cell and written twice: as blocks of codes, in which a vector is its
distance from the centre in one byte a dimension, and as rows with the vector itself. Both are dealt out by ranges
of (cell, hash of the id), so a cell with a third of all vectors is many blocks in many files, and lie in
folders by shelf, a run of cells, so that a search opens the shelves of the cells that it wants.

Searching: each query goes to its nearest cells, in blocks made where the queries are read. Blocks of
codes meet blocks of queries of the same cell, and give the best `OVERSAMPLE` * k of each pair by the distance
to the code; the best of those are looked up among the rows and compared exactly. How many cells to read
is measured when the index is built: as many as give the recall asked for on a sample of the vectors, whose
exact neighbours are found by comparing it with all. An exact search (`exact=True`) goes on: no vector can be nearer to a query than
its centre's distance less its cell's radius, so all cells that may hold a better one than the k-th found are read
too.

Distances are squared Euclidean ones. What comes to the driver is the centres and radii, `MOST_CELLS` at most.

Defined results: rows without a vector or an id are not indexed, and ask nothing; equal distances (to nine
digits) rank by id; vectors must agree in length, and ids be whole numbers; repeated ids are answered as they
come; fewer than k vectors give fewer neighbours; an empty table gives an index that answers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.operators.vectors import QUERY_BLOCK, nearest_in_blocks, squared_l2, top_k_batch
from papyrion.config import RetrievalConfig
from papyrion.session import stage, staging_path

MOST_CELLS = 16_384
#: Sampled vectors for each cell that the centres are fitted on.
FIT_ROWS = 64
ROUNDS = 8
#: Vectors of one block of codes.
BLOCK = 4096
#: Query vectors that a task holds, of all cells, before it hands on what it has.
HELD_QUERIES = 1 << 16
#: Codes are compared to find so many times k candidates.
OVERSAMPLE = 4
RECALL = 0.95
#: Vectors whose exact neighbours say how many cells a search reads.
RECALL_QUERIES = 200
SHELVES = 64


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, its centres and radii, and the number of cells that a search reads."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    probes: int

    def shelf(self, cell: np.ndarray) -> np.ndarray:
        return cell * SHELVES // max(1, len(self.centres))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T), 0)


def _there(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))


def _share(count: int, wanted: int):
    """About ``wanted`` of ``count`` rows, by a hash of their id."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, wanted / max(1, count)))


def _fitted(there: DataFrame, count: int, cells: int, rounds: int) -> np.ndarray:
    sample = stage(there.where(_share(count, 2 * FIT_ROWS * cells)), "index-sample")
    first = sample.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(cells).collect()
    centres = np.unique(np.array([r["vector"] for r in first]), axis=0)
    dims = centres.shape[1]
    for _ in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, counts = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), dims)
                cell = _to_centres(x, sent.value).argmin(axis=1)
                np.add.at(total, cell, x)
                counts += np.bincount(cell, minlength=len(counts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "n", "s"])

        parts = sample.select("vector").mapInArrow(sums, "cell long, n long, s array<double>")
        moved = centres.copy()  # a cell without vectors stays where it is
        for cell, n, *s in parts.groupBy("cell").agg(F.sum("n"), *[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).collect():
            moved[cell] = np.array(s) / n
        if np.abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return centres


def _blocks(batches: Iterator[pa.RecordBatch], sent, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, vec_id, vector), sorted by cell, as blocks of codes."""
    names = ["cell", "ids", "scales", "codes"]

    def emit(cell: int, ids: np.ndarray, x: np.ndarray) -> tuple:
        rest = x - sent.value[cell]
        scale = np.maximum(np.abs(rest).max(axis=1, initial=0) / 127, 1e-300)
        return cell, ids.tobytes(), scale.tobytes(), np.rint(rest / scale[:, None]).astype(np.int8).tobytes()

    held: list[tuple[np.ndarray, np.ndarray]] = []
    at, size = -1, 0
    for batch in batches:
        cells, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = _matrix(batch.column(2), sent.value.shape[1])
        made = []
        borders = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, b in zip(borders, borders[1:]):
            for low in range(a, b, block):
                high = min(b, low + block)
                if held and (cells[low] != at or size + high - low > block):
                    made.append(emit(at, *[np.concatenate(c) for c in zip(*held)]))
                    held, size = [], 0
                at = int(cells[low])
                held.append((ids[low:high], x[low:high]))
                size += high - low
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 4, (pa.int32(), *[pa.binary()] * 3))], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(emit(at, *[np.concatenate(c) for c in zip(*held)]), (pa.int32(), *[pa.binary()] * 3))], names)


def build_index(
    vectors: DataFrame, path: str | None = None, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, rounds: int = ROUNDS, recall: float = RECALL, k: int = 5
) -> VectorIndex:
    """An index of all rows of ``vectors``, written under ``path`` (in the shared folder if none is given)."""
    spark = vectors.sparkSession
    path = path or staging_path(spark, "vector-index")
    there = _there(vectors, key, vector)
    count = there.count()
    cells = min(MOST_CELLS, max(1, cells or math.isqrt(count)))
    centres = _fitted(there, count, cells, rounds) if count else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centres)
    dims = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _to_centres(_matrix(batch.column(1), dims), sent.value)
            cell = d.argmin(axis=1) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(cell)), cell])), *batch.columns], ["cell", "off", "vec_id", "vector"]
            )

    shelf = F.floor(F.col("cell") * SHELVES / max(1, len(centres))).cast("int").alias("shelf")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("cell"), F.xxhash64("vec_id")]
    rows = there.mapInArrow(placed, "cell int, off double, vec_id long, vector array<double>") if count else there.selectExpr("0 cell", "0.0D off", "vec_id", "vector")
    rows.repartitionByRange(n, *order).sortWithinPartitions("cell", "vec_id").select("*", shelf).write.partitionBy("shelf").parquet(f"{path}/rows")
    held = spark.read.schema("cell int, off double, vec_id long, vector array<double>, shelf int").parquet(f"{path}/rows")
    dealt = held.select("cell", "vec_id", "vector").repartitionByRange(n, *order).sortWithinPartitions("cell")
    block = BLOCK
    coded = dealt.mapInArrow(lambda b: _blocks(b, sent, block), "cell int, ids binary, scales binary, codes binary")
    coded.select("*", shelf).sortWithinPartitions("shelf").write.partitionBy("shelf").parquet(f"{path}/codes")
    radii = np.zeros(len(centres))
    for cell, off in held.groupBy("cell").agg(F.max("off")).collect():
        radii[cell] = off
    index = VectorIndex(path, centres, radii, len(centres))
    probes = _probes_for(index, there, count, recall, k) if len(centres) > 1 else len(centres)
    about = spark.createDataFrame([(i, c.tolist(), float(r), probes) for i, (c, r) in enumerate(zip(centres, radii))], "cell int, centre array<double>, radius double, probes int")
    about.write.parquet(f"{path}/centres")
    return VectorIndex(path, centres, radii, probes)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())
    return VectorIndex(path, np.array([r["centre"] for r in rows]).reshape(len(rows), -1), np.array([r["radius"] for r in rows]), rows[0]["probes"] if rows else 0)


def _probes_for(index: VectorIndex, there: DataFrame, count: int, recall: float, k: int) -> int:
    """The least number of cells whose reading finds ``recall`` of the exact neighbours of a sample."""
    asked = there.where(_share(count, RECALL_QUERIES)).orderBy(F.xxhash64("vec_id")).limit(RECALL_QUERIES)
    near = top_k_batch(there, asked, RetrievalConfig(k=k), "vec_id", "vector").select("query_id", "vec_id")
    found = near.join(there.selectExpr("vec_id", "vector"), "vec_id").join(asked.selectExpr("vec_id AS query_id", "vector AS asked"), "query_id")
    pairs = found.select("vector", "asked").collect()  # k for each query of the sample
    if not pairs:
        return len(index.centres)
    v, q = (np.array([p[c] for p in pairs]) for c in ("vector", "asked"))
    cell = _to_centres(v, index.centres).argmin(axis=1)
    d = _to_centres(q, index.centres)
    rank = np.sort((d < d[np.arange(len(d)), cell][:, None]).sum(axis=1))
    return int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)))]) + 1


def _probing(queries: DataFrame, index: VectorIndex, probes: int, bound: bool = False) -> DataFrame:
    """Blocks of the queries that go to each cell: the ``probes`` nearest, or those that may hold something nearer than ``limit``."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = sent.value
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        size = 0

        def emit(found: dict[int, list[tuple[int, np.ndarray]]]) -> pa.RecordBatch:
            cells = sorted(found)
            columns = [
                pa.array(cells, pa.int32()), pa.array(index.shelf(np.array(cells, int)), pa.int32()),
                pa.array([np.array([i for i, _ in found[c]]).tobytes() for c in cells], pa.binary()), pa.array([np.array([v for _, v in found[c]]).tobytes() for c in cells], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["cell", "shelf", "q_ids", "q_data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), centres.shape[1])
            d = _to_centres(x, centres)
            if bound:
                limit = np.sqrt(batch.column(2).to_numpy(zero_copy_only=False))
                # A little more, as distances are rounded.
                wanted = [np.flatnonzero(np.sqrt(row) - radii <= t * (1 + 1e-9) + 1e-6) for row, t in zip(d, limit)]
            else:
                wanted = np.argsort(d, axis=1, kind="stable")[:, :probes]
            for key, vector, cells in zip(batch.column(0).to_pylist(), x, wanted):
                for c in cells.tolist():
                    of = held.setdefault(c, [])
                    of.append((key, vector))
                    size += 1
                    if len(of) >= QUERY_BLOCK:
                        yield emit({c: held.pop(c)})
                        size -= QUERY_BLOCK
                if size >= HELD_QUERIES:
                    yield emit(held)
                    held, size = {}, 0
        if held:
            yield emit(held)

    return queries.mapInArrow(run, "cell int, shelf int, q_ids binary, q_data binary")


def _by_codes(index: VectorIndex, spark: SparkSession, most: int):
    """The ``most`` nearest codes of each pair of blocks: (shelf, cell, query_id, vec_id, about)."""
    sent = spark.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, *raw in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in range(1, 6)]):
                vi, scale, codes, qi, qd = (r.as_buffer() for r in raw)
                ids, asked, s = np.frombuffer(vi, np.int64), np.frombuffer(qi, np.int64), np.frombuffer(scale, np.float64)
                code = np.frombuffer(codes, np.int8).reshape(len(ids), -1).astype(np.float64)
                rest = np.frombuffer(qd, np.float64).reshape(len(asked), -1) - sent.value[cell]
                d = (rest * rest).sum(axis=1)[:, None] + (s * s * (code * code).sum(axis=1))[None, :] - 2 * (rest @ code.T) * s[None, :]
                d = np.maximum(d, 0).round(9)
                rows = []
                for i in range(len(asked)):
                    least = np.partition(d[i], most - 1)[most - 1] if len(ids) > most else np.inf
                    near = np.flatnonzero(d[i] <= least)
                    near = near[np.lexsort((ids[near], d[i][near]))][:most]
                    rows.append((np.full(len(near), asked[i]), ids[near], d[i][near]))
                q, v, about = (np.concatenate(c) for c in zip(*rows))
                where = [pa.array(np.full(len(q), x, np.int32)) for x in (index.shelf(np.array([cell]))[0], cell)]
                yield pa.RecordBatch.from_arrays([*where, pa.array(q), pa.array(v), pa.array(about)], ["shelf", "cell", "query_id", "vec_id", "about"])

    return run


def _best(rows: DataFrame, by: str, most: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(by, "vec_id")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank from 1, vec_id, distance): the nearest vectors of the index to each row of ``queries``."""
    spark = queries.sparkSession
    asked = _there(queries, key, vector).withColumnRenamed("vec_id", "query_id")
    rows = spark.read.schema("cell int, vec_id long, vector array<double>, shelf int").parquet(f"{index.path}/rows")
    if not len(index.centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    asked = stage(asked, "index-queries")
    codes = spark.read.schema("cell int, ids binary, scales binary, codes binary, shelf int").parquet(f"{index.path}/codes")
    wanted = _probing(asked, index, min(probes or index.probes, len(index.centres)))
    met = codes.join(wanted, ["shelf", "cell"]).select("cell", "ids", "scales", "codes", "q_ids", "q_data")
    about = met.mapInArrow(_by_codes(index, spark, OVERSAMPLE * k), "shelf int, cell int, query_id long, vec_id long, about double")
    short = stage(_best(about, "about", OVERSAMPLE * k).select("shelf", "cell", "query_id", "vec_id"), "index-candidates")
    # A repeated id has a row each time; the list has it once.
    compared = rows.join(short.distinct(), ["shelf", "cell", "vec_id"]).join(asked.select("query_id", F.col("vector").alias("asked")), "query_id")
    near = _best(compared.select("query_id", "vec_id", F.round(squared_l2(F.col("vector"), F.col("asked")), 9).alias("distance")), "distance", k)
    if not exact:
        return near.select("query_id", "rank", "vec_id", "distance")
    worst = stage(near.groupBy("query_id").agg(F.max("distance").alias("limit"), F.count("*").alias("n")), "index-limits")
    # A query that found too few is compared with everything.
    limit = F.when(F.col("n") >= k, F.col("limit")).otherwise(F.lit(float("inf")))
    bounded = asked.join(worst, "query_id", "left").select("query_id", "vector", F.coalesce(limit, F.lit(float("inf"))).alias("limit"))
    wanted = _probing(bounded, index, 0, bound=True)
    packed = rows.select("shelf", "cell", "vec_id", "vector").mapInArrow(_packed_rows, "shelf int, cell int, v_ids binary, v_data binary")
    met = packed.join(wanted, ["shelf", "cell"]).select("v_ids", "v_data", "q_ids", "q_data")
    all_near = met.mapInArrow(nearest_in_blocks(k, "l2"), "query_id long, vec_id long, distance double")
    return _best(all_near, "distance", k).select("query_id", "rank", "vec_id", "distance")


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an index as blocks of one cell."""
    for batch in batches:
        # In order of cells: a batch may hold the rows of a shelf in any order, and a block of one row meets all queries too.
        batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
        cells = batch.column(1).to_numpy()
        borders = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
        ids, x = batch.column(2).to_numpy(), np.asarray(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.float64)
        x = x.reshape(len(cells), -1) if len(cells) else x
        spans = list(zip(borders, borders[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i).take(pa.array([a for a, _ in spans], pa.int64())) for i in (0, 1)],
                *[pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (ids, x)],
            ],
            ["shelf", "cell", "v_ids", "v_data"],
        )
