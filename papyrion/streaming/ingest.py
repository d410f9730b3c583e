"""Pages that arrive in a folder are chunked into the cache as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from papyrion.config import ChunkConfig
from papyrion.operators.split import Embedder
from papyrion.plans.pipeline import cached_chunks
from papyrion.session import stage
from papyrion.sources.cache import ChunkCache

PAGES = "batch_id string, page_no long, text string"


def watch_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of pages under ``path``, as a stream. A batch lies in one file."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(
    pages: DataFrame, cache: ChunkCache, checkpoint: str, config: ChunkConfig = ChunkConfig(), embed: Embedder | None = None, once: bool = False
) -> StreamingQuery:
    """Chunk each micro-batch into ``cache``. A micro-batch that runs again, or a file that comes twice, adds nothing."""

    def take(batch: DataFrame, number: int) -> None:
        # Written, so that the source is read once, however often its pages are looked at.
        cached_chunks(stage(batch, "micro-batch"), cache, config, embed)

    writer = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
