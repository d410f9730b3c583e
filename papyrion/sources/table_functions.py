"""The splitters as table functions for SQL.

    register(spark)
    SELECT * FROM fixed_chunks(TABLE(pages), 1000, 100)
    SELECT * FROM semantic_chunks(TABLE(pages) PARTITION BY batch_id ORDER BY page_no)

``pages`` has (batch_id, page_no, text); the result (batch_id, page_no, piece, start_index, text) of each chunk, as
`operators.split` makes them. Without PARTITION BY, pages are split where they are; with it, a partition is the work of one
task, so it suits what is small, or has to come in order.

Defined results: those of the splitters; ids come back as text, since a table function says its columns before it sees the table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.operators.split import Embedder, HashEmbedder, fixed_chunks, semantic_chunks

_CHUNK = "batch_id string, page_no long, piece int, start_index int, text string"


def _rows(page: Row, found: list[tuple[int, str]]) -> Iterator[tuple]:
    batch = page["batch_id"]
    for piece, (start, text) in enumerate(found):
        yield None if batch is None else str(batch), page["page_no"], piece, start, text


def register(spark: SparkSession, embed: Embedder | None = None, config: ChunkConfig = ChunkConfig()) -> None:
    """Make ``fixed_chunks`` and ``semantic_chunks`` known to SQL; ``embed`` is the embedder of the latter, the hashed stand-in if none is given."""
    embedder = embed or HashEmbedder()

    class Fixed:
        def eval(self, page: Row, size: int = config.size, overlap: int = config.overlap) -> Iterator[tuple]:
            yield from _rows(page, fixed_chunks(page["text"] or "", size, overlap))

    class Semantic:
        def eval(self, page: Row) -> Iterator[tuple]:
            yield from _rows(page, semantic_chunks(page["text"] or "", embedder, config))

    for name, kind in (("fixed_chunks", Fixed), ("semantic_chunks", Semantic)):
        spark.udtf.register(name, F.udtf(kind, returnType=_CHUNK))
