"""What a run did, counted while its data passes.

`run` writes chunks and gives their numbers, from an `Observation` on what is written, and the time it took, from a clock. So a
report costs no further pass over pages or chunks. `Progress` does the same for a stream of pages: a listener that is told by
Spark, once for each micro-batch, how many pages went through and how long it took.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from papyrion.config import ChunkConfig
from papyrion.operators.split import Embedder
from papyrion.plans.pipeline import chunk
from papyrion.session import staging_path

#: The name under which a stream of pages is observed.
PAGES = "pages"


@dataclass(frozen=True)
class Run:
    """Numbers of a run: chunks, their characters, the shortest and longest, chunks with context, and milliseconds."""

    n_chunks: int
    n_chars: int
    least: int | None
    most: int | None
    n_enhanced: int
    took_ms: int


def _numbers() -> list:
    n = F.length("text")
    return [
        F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("n_chars"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.count_if(F.coalesce("enhanced", F.lit(False))).alias("n_enhanced"),
    ]


def run(
    pages: DataFrame, config: ChunkConfig = ChunkConfig(), embed: Embedder | None = None, path: str | None = None, chunker: Callable[..., DataFrame] = chunk
) -> tuple[DataFrame, Run]:
    """The chunks of ``pages``, written to ``path`` (the shared folder if none is given), and the numbers of the run."""
    spark = pages.sparkSession
    path = path or staging_path(spark, "measured-chunks")
    began = time.monotonic()
    seen = Observation("chunks")
    made = chunker(pages, config, embed).observe(seen, *_numbers())
    made.write.parquet(path)
    took = round(1000 * (time.monotonic() - began))
    return spark.read.schema(made.schema).parquet(path), Run(**seen.get, took_ms=took)


def observed(pages: DataFrame) -> DataFrame:
    """A stream of pages whose numbers `Progress` is told of."""
    return pages.observe(PAGES, F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@dataclass
class Progress(StreamingQueryListener):
    """Of each micro-batch of an `observed` stream: (number, pages, characters, milliseconds). To be given to ``spark.streams.addListener``."""

    steps: list[tuple[int, int, int, int]] = field(default_factory=list)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        made = event.progress
        if (row := made.observedMetrics.get(PAGES)) is not None:
            self.steps.append((made.batchId, row["n_pages"], row["n_chars"], made.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def n_pages(self) -> int:
        return sum(s[1] for s in self.steps)
