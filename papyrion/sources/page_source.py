"""Files of pages as a data source, for SQL and for `spark.read`.

    register(spark)
    CREATE TEMPORARY VIEW uploads USING page_files OPTIONS (path '...', glob '*.txt', lastPage '2')
    spark.read.format("page_files").option("glob", "*.txt").load("...")

Gives (batch_id, page_no, text, error), the same rows as `pages.scan_files`. ``glob`` chooses files by name before any is opened,
``under`` those below a folder of the path, ``firstPage`` and ``lastPage`` pages before they leave the reader. Files are dealt
out so that a task has at most ``maxPartitionBytes`` (128 MB) of them, or one file; rows leave in batches of some megabytes.

Conditions of a query are not pushed down: Spark 4.1.2 keeps what one query pushed into a Python reader for the next
one over the same DataFrame or view, and for both sides of a union, which gave wrong rows when it was tried. Options belong to one reader.

Readers run in Python workers, so a path must be of a kind that pyarrow's file systems know (local, hdfs, s3, gs, abfs); where a
store can only be read by Spark, `pages.scan_files` is the way.

Defined results: a file that the parser fails on is a row with ``error`` alone, whatever pages are chosen; an empty folder and an empty file have
no rows; a folder that does not exist is an error before a job starts. Names that begin with ``.`` or ``_`` are no files, as elsewhere in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from papyrion.sources.pages import Parser, text_parser

SCHEMA = "batch_id string, page_no int, text string, error string"
_ARROW = pa.schema([("batch_id", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("error", pa.string())])
#: Bytes of files in a task, characters of text in a batch of rows.
PARTITION_BYTES = 128 << 20
BATCH_CHARS = 4 << 20


class _Files(D.InputPartition):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        super().__init__(names)


class PageReader(D.DataSourceReader):
    def __init__(self, options: dict, parse: Parser) -> None:
        self.path, self.glob, self.parse = options["path"], options.get("glob", "*"), parse
        self.most = int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.under = options.get("under", "").strip("/")
        self.first, self.last = int(options.get("firstPage", 0)), int(options.get("lastPage", 2**31 - 1))

    def _opened(self) -> tuple[fs.FileSystem, str, str]:
        """The file system, the path in it, and what goes before such a path to make a batch's name, as Spark writes it."""
        at = urlsplit(self.path)
        if not at.scheme or at.scheme == "file":
            return fs.LocalFileSystem(), self.path.removeprefix("file://").removeprefix("file:"), "file:"
        system, inside = fs.FileSystem.from_uri(self.path)
        return system, inside, f"{at.scheme}://{'' if inside.startswith(at.netloc) else at.netloc}"

    def partitions(self) -> list[D.InputPartition]:
        system, root, before = self._opened()
        root = "/".join([root.rstrip("/"), self.under]) if self.under else root
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda path: any(part[:1] in ("_", ".") and "=" not in part for part in path[len(root) :].split("/"))
        files = [f for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path) and fnmatchcase(f.base_name, self.glob)]
        dealt, held = [[]], 0
        for f in sorted(files, key=lambda f: f.path):
            if dealt[-1] and held + f.size > self.most:
                dealt.append([])
                held = 0
            dealt[-1].append((before + f.path, f.path))
            held += f.size
        return [_Files(names) for names in dealt]

    def _rows(self, system: fs.FileSystem, names: list[tuple[str, str]]) -> Iterator[tuple]:
        for batch, path in names:
            # A store that fails is the task's error, which Spark tries again; a parser that fails is a row.
            with system.open_input_file(path) as file:
                content = file.read()
            # All pages are made before any is given, so that a file that fails half way gives its error alone.
            try:
                rows = [(batch, i, text, None) for i, text in enumerate(self.parse(content)) if self.first <= i <= self.last]
            except Exception as e:  # noqa: BLE001  whatever the parser raises is this file's result
                rows = [(batch, None, None, f"{type(e).__name__}: {e}")]
            yield from rows

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        system = self._opened()[0]
        held, chars = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)

        for row in self._rows(system, partition.value):
            held.append(row)
            chars += len(row[2] or "") + 64
            if chars >= BATCH_CHARS:
                yield batch()
                held, chars = [], 0
        if held:
            yield batch()


def register(spark: SparkSession, parse: Parser = text_parser, name: str = "page_files") -> None:
    """Make ``name`` a data source for files whose pages ``parse`` finds; another parser takes another name."""

    class PageFiles(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return PageReader(self.options, parse)

    spark.dataSource.register(PageFiles)
