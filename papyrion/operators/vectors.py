"""Embedding of texts and exact nearest neighbours.

One query vector is a literal in the plan: distances are built-in expressions,
and only the k best rows of each task leave it. Many queries are compared in
blocks: vectors and queries are packed into matrices where they are read, each
pair of blocks is some products of matrices that give back k rows per query, and
a ranked window keeps the k best of those, limited before the shuffle. Nothing
comes to the driver.

Every block of queries meets every block of vectors, since an exact answer takes each
distance; a pair of blocks is the work of one task and of bounded size.

Defined results: rows without a vector or an id are no neighbours and ask nothing; equal
distances (to nine digits) rank by id; vectors must agree in length; fewer than k
rows give fewer neighbours; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.config import RetrievalConfig
from papyrion.operators.order import in_slices
from papyrion.operators.split import Embedder
from papyrion.session import stage

QUERY_BLOCK = 512
#: Queries of a block that are compared with a block of vectors at once.
QUERY_ROWS = 64
#: Texts that are embedded in one call.
EMBED_ROWS = 512
#: Blocks in one row group where they are written.
BLOCK_GROUP = 4


def token_bucket(token: Column, dims: int = 64) -> Column:
    """The bucket that `split.HashEmbedder` gives a token."""
    head = F.md5(token)
    return (F.ascii(head) * 16 + F.ascii(F.substring(head, 2, 1))) % dims


def bucket_counts(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, bucket, n): the hashed embedding as rows, counted before the shuffle."""
    tokens = texts.select(key, F.explode(F.split(F.col(text), "\\s+")).alias("token")).where("token <> ''")
    return tokens.groupBy(key, token_bucket(F.col("token"), dims).alias("bucket")).agg(F.count("*").alias("n"))


def embed_texts(rows: DataFrame, embed: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """``rows`` with the vector of ``text``, made in Arrow batches; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, EMBED_ROWS):
            texts = [t.as_py() or "" for t in batch.column(0)]
            made = np.asarray(embed(texts), np.float64) if texts else np.empty((0, 0))
            lists = pa.array(list(made), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["__row", "__vector"])

    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != out]).alias("__row")
    shaped = rows.select(F.col(f"`{text}`").cast("string").alias("__text"), kept)
    made = shaped.mapInArrow(run, T.StructType([shaped.schema["__row"], T.StructField("__vector", T.ArrayType(T.DoubleType()))]))
    return made.select("__row.*", F.col("__vector").alias(out))


def squared_l2(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a vector of zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def top_k(
    vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", metric: str = "l2"
) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to one query vector, with ``distance`` (squared L2, or cosine)."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    distance = squared_l2 if metric == "l2" else cosine_distance
    there = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    near = there.select(key, distance(F.col(vector), asked).alias("distance"))
    return near.orderBy(F.round("distance", 9), key).limit(k)


def _packed(rows: DataFrame, key: str, vector: str, block: int, prefix: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []

        def emit(n: int) -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(data)
            ids[:], data[:] = [i[n:]], [v[n:]]
            return pa.RecordBatch.from_arrays([pa.array([i[:n].tobytes()]), pa.array([v[:n].tobytes()])], [f"{prefix}_ids", f"{prefix}_data"])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                data.append(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1))
                while sum(map(len, ids)) >= block:
                    yield emit(block)
        if left := sum(map(len, ids)):
            yield emit(left)

    chosen = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long"), F.col(vector).cast("array<double>")
    )
    return chosen.mapInArrow(run, f"{prefix}_ids binary, {prefix}_data binary")


def nearest_in_blocks(k: int, metric: str):
    """The ``k`` nearest of each pair of blocks (v_ids, v_data, q_ids, q_data), and what else comes in front of these, as it is."""

    def distances(v: np.ndarray, vv: np.ndarray, q: np.ndarray) -> np.ndarray:
        dots, qq = q @ v.T, (q * q).sum(axis=1)
        if metric == "l2":
            d = qq[:, None] + vv[None, :] - 2 * dots
        else:
            d = 1 - dots / np.maximum(np.sqrt(qq[:, None] * vv[None, :]), 1e-300)
        return np.maximum(d, 0).round(9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.schema.names[:-4]
            for row, (vi, vd, qi, qd) in enumerate(zip(*[batch.column(c) for c in ("v_ids", "v_data", "q_ids", "q_data")])):
                ids, asked = np.frombuffer(vi.as_buffer(), np.int64), np.frombuffer(qi.as_buffer(), np.int64)
                v = np.frombuffer(vd.as_buffer(), np.float64).reshape(len(ids), -1)
                q = np.frombuffer(qd.as_buffer(), np.float64).reshape(len(asked), -1)
                vv, rows = (v * v).sum(axis=1), []
                for low in range(0, len(asked), QUERY_ROWS):
                    d = distances(v, vv, q[low : low + QUERY_ROWS])
                    for key, row_d in zip(asked[low : low + QUERY_ROWS], d):
                        least = np.partition(row_d, k - 1)[k - 1] if len(ids) > k else np.inf
                        near = np.flatnonzero(row_d <= least)
                        near = near[np.lexsort((ids[near], row_d[near]))][:k]
                        rows.append((np.full(len(near), key), ids[near], row_d[near]))
                found = [pa.array(np.concatenate(c)) for c in zip(*rows)]
                same = [batch.column(c).take(pa.array(np.full(len(found[0]), row))) for c in carried]
                yield pa.RecordBatch.from_arrays([*same, *found], [*carried, "query_id", "vec_id", "distance"])

    return run


def _packed_by(rows: DataFrame, batch: str, key: str, vector: str, block: int, prefix: str) -> DataFrame:
    """Blocks of rows of one batch: dealt by ranges of (batch, hash of the id), so a batch with a third of all rows is in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emit() -> pa.RecordBatch:
            ids = np.concatenate([h.column(1).to_numpy() for h in held])
            data = np.concatenate([np.asarray(h.column(2).flatten().to_numpy(zero_copy_only=False), np.float64) for h in held])
            return pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], ["batch", f"{prefix}_ids", f"{prefix}_data"])

        for found in batches:
            names = found.column(0).to_pylist()
            starts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)] if names else [0]
            for a, b in zip(starts, starts[1:]):
                for low in range(a, b, block):
                    part = found.slice(low, min(b, low + block) - low)
                    if held and (held[0].column(0)[0].as_py() != names[low] or size + part.num_rows > block):
                        yield emit()
                        held, size = [], 0
                    held.append(part)
                    size += part.num_rows
        if held:
            yield emit()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    chosen = there.select(F.col(batch).alias("batch"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    dealt = chosen.repartitionByRange(n, F.col("batch").asc_nulls_first(), F.xxhash64("key")).sortWithinPartitions(F.col("batch").asc_nulls_first(), "key")
    blocks = T.StructType([chosen.schema["batch"], *[T.StructField(f"{prefix}_{c}", T.BinaryType()) for c in ("ids", "data")]])
    return dealt.mapInArrow(run, blocks)


def top_k_in_batches(
    vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), batch: str = "batch_id", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(batch, query_id, rank from 1, vec_id, distance): the nearest of ``vectors`` that are in the query's own batch.

    Blocks of vectors and of queries are joined by batch, so a query never meets another batch; a null batch is a batch.
    An id may ask in several batches, and is answered in each.
    """
    v = stage(_packed_by(vectors, batch, key, vector, config.block, "v"), "vector-blocks", group=BLOCK_GROUP)
    q = stage(_packed_by(queries, batch, key, vector, QUERY_BLOCK, "q"), "query-blocks", group=BLOCK_GROUP).withColumnRenamed("batch", "__batch")
    met = v.join(q, F.col("batch").eqNullSafe(F.col("__batch"))).select("batch", "v_ids", "v_data", "q_ids", "q_data")
    near = met.mapInArrow(nearest_in_blocks(config.k, config.metric), T.StructType([met.schema["batch"], *T.StructType.fromDDL("query_id long, vec_id long, distance double").fields]))
    ranked = Window.partitionBy("batch", "query_id").orderBy("distance", "vec_id")
    best = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= config.k)
    return best.select(F.col("batch").alias(batch), "query_id", "rank", "vec_id", "distance")


def top_k_batch(
    vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank from 1, vec_id, distance) of the nearest rows of ``vectors`` to each row of ``queries``."""
    # Written, else each pair of tasks would pack both sides again, in Python workers of its own.
    packed = stage(_packed(vectors, key, vector, config.block, "v"), "vector-blocks", group=BLOCK_GROUP)
    asked = stage(_packed(queries, key, vector, QUERY_BLOCK, "q"), "query-blocks", group=BLOCK_GROUP)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out anew: blocks are few large rows, of which a split of a file would hold hundreds.
    blocks = packed.repartition(n).crossJoin(asked)
    near = blocks.select("v_ids", "v_data", "q_ids", "q_data").mapInArrow(nearest_in_blocks(config.k, config.metric), "query_id long, vec_id long, distance double")
    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "distance")
