"""Page documents: (batch_id, page_no, text) from files or tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], Iterable[str]]

#: Pages of a file that leave its task together.
PAGES_OUT = 256


def scan_files(spark: SparkSession, path: str, parse: Parser, glob: str = "*.pdf") -> DataFrame:
    """The pages that ``parse`` finds in each file whose name fits ``glob``; the batch is the file's path.

    Also (page_no null, ``error``) for a file that ``parse`` fails on, so one bad file stops nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def parsed(name: str, content: bytes) -> list[tuple]:
        try:
            return [(name, i, text, None) for i, text in enumerate(parse(content))]
        except Exception as e:  # noqa: BLE001  whatever the parser raises is this file's result
            return [(name, None, None, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = parsed(name.as_py(), content.as_py())
                # One file's pages are held, and leave in parts.
                for low in range(0, len(rows), PAGES_OUT):
                    columns = zip(*rows[low : low + PAGES_OUT])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch_id", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "batch_id string, page_no int, text string, error string")


def text_parser(content: bytes) -> list[str]:
    """Pages of a plain text file, which form feeds divide."""
    return content.decode("utf-8", "replace").split("\f")


def document_pages(documents: DataFrame, batch: str = "doc_id") -> DataFrame:
    """Each document as a page: of its own batch, or of that of another column, in the order of ids."""
    number = F.lit(0).cast("long") if batch == "doc_id" else F.col("doc_id").cast("long")
    return documents.select(F.col(batch).alias("batch_id"), number.alias("page_no"), "text")


def line_pages(documents: DataFrame) -> DataFrame:
    """Each line of a document as a page of its batch."""
    return documents.select(F.col("doc_id").alias("batch_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page_no", "text"))


def batch_text(pages: DataFrame) -> DataFrame:
    """The pages of each batch joined by line feeds: a batch is one row by definition."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return pages.groupBy("batch_id").agg(F.count("*").alias("n_pages"), joined.alias("text"))
