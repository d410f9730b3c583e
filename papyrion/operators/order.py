"""A dense global order of rows without a window over a hot key.

Rows are dealt out by ranges of their sort key and sorted inside each task; their
place is the number of rows in the tasks before plus their place in the task. A
batch with a third of all rows spreads over a third of the tasks, and whatever
needs its neighbours finds them by place, not by gathering the batch.

Rows with a text also get the number of their block: a run of rows with about `BLOCK_BYTES`
bytes of text, whatever the tasks were (see `sizing`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.session import stage

#: Bytes of text in a block of rows, about; a row counts as `ROW_BYTES` besides its text.
BLOCK_BYTES = 1 << 19
ROW_BYTES = 64
#: What `measured` adds: the size of a row, of the row before, and of all rows before in the task.
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in ("__size", "__size_before", "__before")])


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at most at a time: Spark's batches have up to 64 MB, which are many times more as objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def in_order(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """``df`` in global order: tasks hold ranges that follow each other, each sorted."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `MEASURES` of their column ``text``; a task's first row has no size before."""
    so_far, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("text").cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]) + ROW_BYTES
        ends = so_far + np.cumsum(sizes)
        before = pa.array([last, *sizes[:-1].tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), before, pa.array(ends - sizes)], [*batch.schema.names, *MEASURES.names])
        so_far, last = int(ends[-1]), int(sizes[-1])


def numbered(df: DataFrame, batch: str = "batch_id", name: str = "numbered", counted: bool = True) -> DataFrame:
    """``df``, whose rows are in global order, with ``place`` and, if ``counted``, of its batch ``first_place`` and ``batch_rows``.

    If there is a column ``text``, also with ``block``, ``block_before`` and ``block_after``, the blocks of the row and
    of those beside it. The rows are written to the shared folder. A null batch is a batch.
    """
    sized = "text" in df.columns
    if sized and "__size" not in df.columns:
        df = df.mapInArrow(measured, T.StructType([*df.schema.fields, *MEASURES.fields]))
    held = stage(df.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    # One row per task, so the window over all of them is small, and so is what is sent out.
    sizes = held.groupBy(part.alias("__part")).agg(
        F.count("*").alias("size"), *([F.sum("__size").alias("bytes"), F.max_by("__size", "__at").alias("last")] if sized else [])
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "__part",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__base"),
        *([F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"), F.lag("last").over(Window.orderBy("__part")).alias("__last")] if sized else []),
    )
    placed = held.withColumn("__part", part).join(F.broadcast(bases), "__part")
    placed = placed.withColumn("place", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    if sized:
        start = F.col("__bytes") + F.col("__before")
        block = lambda at: F.floor(at / BLOCK_BYTES)
        placed = placed.withColumns(
            {
                "block": block(start),
                "block_before": block(start - F.coalesce("__size_before", "__last")),
                "block_after": block(start + F.col("__size")),
            }
        ).drop("__bytes", "__last", *MEASURES.names)
    placed = placed.drop("__base", "__at").withColumnRenamed("__part", "part")
    return with_counts(placed, placed, batch) if counted else placed


def with_counts(rows: DataFrame, placed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``rows`` with ``first_place`` and ``batch_rows`` of their batches in ``placed``."""
    about = placed.groupBy(F.col(batch).alias("__batch")).agg(F.min("place").alias("first_place"), F.count("*").alias("batch_rows"))
    return rows.join(about, F.col(batch).eqNullSafe(F.col("__batch")), "inner").drop("__batch")


def last_place(placed: DataFrame, flag: Column) -> Column:
    """Not for use on its own: the last place with ``flag`` in the task's part, up to this row."""
    so_far = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.max(F.when(flag, F.col("place"))).over(so_far)


def anchored(placed: DataFrame, flag: Column, out: str) -> DataFrame:
    """Add the place of the last row with ``flag`` at or before each row in its batch, or else the batch's first place."""
    # What a part hands on is one number, and there is one part per task.
    ends = placed.groupBy("part").agg(F.max(F.when(flag, F.col("place"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.max("last").over(before).alias("__carried"))
    local = placed.select("*", last_place(placed, flag).alias("__local"))
    joined = local.join(F.broadcast(carried), "part")
    return joined.withColumn(out, F.greatest("first_place", "__local", "__carried")).drop("__local", "__carried")
