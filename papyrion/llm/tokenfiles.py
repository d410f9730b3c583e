"""Token ids as Parquet files that can be read in part.

A file holds documents in ascending order of (id, text hash), one row each:
``doc_id``, ``n_tokens``, ``shard``, ``shard_start`` (tokens of the shard before
this document) and the list column ``ids``. Spark's own writer makes them, with
these settings

* ``ids``: dictionary pages, so that an id takes as many bits as its page needs;
* the integer columns: format version 2, which delta-encodes them where the
  dictionary does not pay;
* small row groups and pages, so that the column index (which the writer always
  adds) lets a reader with a filter on ``doc_id`` skip most pages, and a reader
  of the integer columns never touches the ids.

The corpus is dealt out by ranges of (id, text hash) before it is tokenised, so
texts are shuffled once and ids never. A hot id, or null, spreads over shards by
its hash. Positions in the corpus are the sum over all earlier shards, which is
a table with one row per shard, plus ``shard_start``.

Defined results: null or empty text has the end token alone; a null id sorts
first; repeated rows stay repeated, next to each other; extra columns are not
written; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm import tokens
from papyrion.llm.common import number
from papyrion.session import staging_path

ROWS = "doc_id long, n_tokens long, shard int, shard_start long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

_FORMAT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


def _encode_shard(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.encoder(tokenizer), TaskContext.get()
        shard, done = task.partitionId() if task else 0, 0
        for batch in batches:
            for k, ids, bounds in encoder.blocks(batch.column(1)):
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                bounds = bounds + np.arange(len(bounds))
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, n),
                        pa.array(np.diff(bounds)),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(done + bounds[:-1]),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
                    ],
                    ["doc_id", "n_tokens", "shard", "shard_start", "ids"],
                )
                done += len(ids)

    return run


def write_token_files(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None
) -> None:
    """Tokenise ``docs`` into Parquet files under ``path``; ``shards`` defaults to the session's shuffle partitions."""
    spark = docs.sparkSession
    chosen = docs.select(number(docs, key).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_encode_shard(tokenizer or tokens.default_tokenizer(), end_id), ROWS).write.options(**_FORMAT).parquet(path)


def read_token_files(spark, path: str, ids: bool = True) -> DataFrame:
    """Rows of the files with ``start``, the tokens of all documents before. Without ``ids``, their pages stay unread."""
    rows = spark.read.schema(ROWS).parquet(path)
    # One row per shard, so the window over all of them is small.
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    found = rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("shard_start"))
    return found.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids) with the CRC-32 of the ids in the place of the ids."""
    for batch in batches:
        raw = batch.column(3).values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
        bounds = batch.column(3).offsets.to_numpy().tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = staging_path(spark, "token-files")
    write_token_files(docs, path)
    return read_token_files(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
