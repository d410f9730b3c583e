"""WARC archives with an external merge of their capture indexes.

Writing: each task sorts its captures by (URL key, time, page) and writes them as
WARC records, each a gzip member of its own, so that a record can be read with its
offset and length alone. Spark's text writer puts the members into files, with an empty
member as line separator (which every reader of gzip passes over), so archives have
Spark's commit protocol, and work on any store that Spark can write. A task closes an archive
once its members have `ARCHIVE_BYTES` bytes, or at `ARCHIVE_RECORDS` records, and the archives of a
number lie in a folder of theirs. So an archive that is read as one value stays far below the limit of a value,
unless a single record exceeds it. Of records with equal
payloads of at least `REVISIT_BYTES` bytes, that with the largest page id is the response
and the others are revisits that refer to it.

Reading: archives are cut into members and records one after the other; payload
digests are computed anew and must agree.

Index: each archive is a run of captures in order. Captures are dealt out by
ranges of (URL key, time, page), and each task merges the pieces of the k runs
that fall into its range with a loser tree. It holds one range, of about `RANGE_ROWS`
captures, as the number of ranges grows with that of captures; captures equal in all three are dealt
out by their place in the archives, so they spread as well. Ranges follow each other, so the positions of all captures in the global order are those
in their range plus the sizes of the ranges before: capture histories, one after
the other. A URL with very many captures spreads over ranges by time and page.

URL key: the labels of the host, last first, joined by commas, then ``)`` and what
follows the host without fragment. Times are written in UTC, whatever the session's time
zone. Without a column of capture times, time is 2024-01-01 plus page_id seconds (modulo ten years).

Defined results: page ids must be whole numbers; null html is an empty payload; null url has an empty key and no
target; characters in a url that would end its header line are percent-encoded;
a null page id is the smallest, and is never referred to unless all copies have
none (then all of them are responses); rows equal in id and payload are all
responses if theirs is the largest id, and share their record id; extra columns are not
carried; empty table in, empty table out.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.common import number
from papyrion.llm.urls import host_and_path
from papyrion.session import stage, staging_path

REVISIT_BYTES = 1000
#: Records in one archive, at most.
ARCHIVE_RECORDS = 20_000
#: Bytes of an archive, about: the next record begins another one.
ARCHIVE_BYTES = 1 << 26
#: Captures of one range of the merge, about.
RANGE_ROWS = 200_000
_BASE_SECOND = 1_704_067_200  # 2024-01-01
_TEN_YEARS = 315_360_000
#: A gzip member without content.
_EMPTY = zlib.compress(b"", 9, 31)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def safe_url(url: Column) -> Column:
    """Without the characters that would end a header line."""
    out = F.coalesce(url, F.lit(""))
    for raw, quoted in (("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        out = F.replace(out, F.lit(raw), F.lit(quoted))
    return out


def url_key(url: Column) -> Column:
    host, _ = host_and_path(url)
    rest = F.regexp_extract(F.substring(url, F.locate("://", url) + 3, F.length(url)), "^[^/?#]*([^#]*)", 1)
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest))


def captures(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", time: str | None = None) -> DataFrame:
    """One row per page: what its record will say."""
    default = F.timestamp_seconds(F.lit(_BASE_SECOND) + F.pmod(F.coalesce(number(pages, page), F.lit(0)), F.lit(_TEN_YEARS)))
    df = pages.select(
        number(pages, page).alias("page_id"),
        safe_url(F.col(f"`{url}`").cast("string")).alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
        F.unix_seconds(default if time is None else F.coalesce(F.col(f"`{time}`").cast("timestamp"), default)).alias("second"),
    )
    # From seconds, since formatting a timestamp would take the session's time zone.
    day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("second") / 86400).cast("int")), F.pmod("second", F.lit(86400))
    df = df.select(
        "page_id", "url", "html", url_key(F.col("url")).alias("url_key"),
        F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60).alias("time"),
        F.octet_length("html").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"),
    )
    # Digests of payloads that occur more than once, written so that their size is known to the join.
    copied = df.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    copied = stage(copied.where("n > 1").select("digest", "original"), "copied-payloads")
    joined = df.join(copied, "digest", "left")
    revisit = F.col("original").isNotNull() & ((F.col("page_id") < F.col("original")) | F.col("page_id").isNull())
    return joined.withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def _record() -> Column:
    """The record of a capture."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", page, ">"),
        line("WARC-Date: ", F.col("time")),
        F.when(F.col("url") == "", "").otherwise(line("WARC-Target-URI: ", F.col("url"))),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To: <urn:page:", F.col("refers_to").cast("string"), ">"), line("WARC-Profile: ", _PROFILE))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )


def _members(limit: int):
    """Members, each with the number of its archive and its own in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size, n = 0, 0, 0
        for batch in batches:
            made, archives = [], []
            for record in batch.column(0):
                made.append(zlib.compress(record.as_buffer(), 6, 31))
                if size and size + len(made[-1]) > limit:
                    archive, size = archive + 1, 0
                archives.append(archive)
                size += len(made[-1]) + len(_EMPTY)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(archives, pa.int32()), pa.array(range(n, n + len(made)), pa.int64())], ["value", "archive", "n"])
            n += len(made)

    return run


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Archives under ``path``, each a run sorted by (URL key, time, page)."""
    made = captures(pages, **columns).sortWithinPartitions("url_key", "time", "page_id").select(_record().alias("value"))
    # In this order already, but the writer has to know it.
    members = made.mapInArrow(_members(ARCHIVE_BYTES), "value binary, archive int, n long").sortWithinPartitions("archive", "n")
    # The text writer takes the bytes as they are.
    members.select(F.col("value").cast("string"), "archive").write.partitionBy("archive").options(
        encoding="ISO-8859-1", lineSep=_EMPTY.decode("latin-1"), maxRecordsPerFile=str(ARCHIVE_RECORDS)
    ).text(path)


_INDEX = [
    ("run", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("time", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
]
INDEX = "run string, page_id long, url string, time string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"


def _page(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def read_members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that has content."""
    offset = 0
    while offset < len(data):
        inflater, at, parts = zlib.decompressobj(31), offset, []
        while not inflater.eof and at < len(data):
            parts.append(inflater.decompress(data[at : at + (1 << 16)]))
            at += 1 << 16
        if not inflater.eof:
            raise ValueError(f"the member at {offset} is cut short")
        end = min(at, len(data)) - len(inflater.unused_data)
        if content := b"".join(parts):
            yield offset, end - offset, content
        offset = end


def read_records(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a member."""
    while line := raw.readline():
        headers = {}
        if line.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"no record: {line[:60]!r}")
        while (line := raw.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        n = int(headers["content-length"])
        block, end = raw.read(n), raw.read(4)
        if len(block) != n or end != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _INDEX]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            run, rows = path.as_py(), []
            for offset, length, member in read_members(memoryview(content.as_buffer())):
                for headers, block in read_records(io.BytesIO(member)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{run}: the payload at {offset} is damaged")
                    rows.append((
                        run, _page(headers["warc-record-id"]), headers.get("warc-target-uri", ""), headers["warc-date"], kind,
                        _page(headers.get("warc-refers-to")), size, digest, offset, length,
                    ))
                if len(rows) >= 4096:
                    yield _rows(rows, names)
                    rows = []
            yield _rows(rows, names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _INDEX)], names)


def read_captures(spark, path: str) -> DataFrame:
    """The index of the archives under ``path``: one row per record, in each archive in its order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(_parse, INDEX)
    return found.withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: each inner node remembers the loser of its match, the root's winner comes next."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k  # at 0 the winner
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.losers[node] < 0:  # nobody to play yet
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            node, winner = (w + self.k) // 2, w
            while node:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range in order, numbered, from the pieces of the runs in it."""
    held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if held is None or not held.num_rows:
        return
    none = -(2**63)
    pages = [none if p is None else p for p in held.column("page_id").to_pylist()]
    keys = list(zip(*[held.column(c).to_pylist() for c in ("url_key", "time")], pages, *[held.column(c).to_pylist() for c in ("run", "offset")]))
    runs: dict[str, list[int]] = {}
    for i, run in enumerate(held.column("run").to_pylist()):
        runs.setdefault(run, []).append(i)
    for rows in runs.values():  # the shuffle keeps the order of a block, not that of blocks
        if any(keys[a] > keys[b] for a, b in zip(rows, rows[1:])):
            rows.sort(key=keys.__getitem__)
    # Rows as (key, number): the tree compares keys, and the number finds the row again.
    order = [i for _, i in LoserTree([iter([(keys[i], i) for i in rows]) for _, rows in sorted(runs.items())])]
    task = TaskContext.get()
    merged = held.take(pa.array(order))
    merged = merged.append_column("range", pa.array(np.full(len(order), task.partitionId() if task else 0, np.int32)))
    merged = merged.append_column("at", pa.array(np.arange(len(order), dtype=np.int64)))
    yield from merged.to_batches(max_chunksize=8192)


def merge_index(captured: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures with ``position``, their place in the order of (URL key, time, page). ``captured`` is read three times."""
    spark = captured.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(captured.count() / RANGE_ROWS))
    order = [F.col("url_key"), F.col("time"), F.col("page_id").asc_nulls_first(), F.col("run"), F.col("offset")]
    merged = captured.repartitionByRange(n, *order).mapInArrow(_merge, INDEX + ", url_key string, range int, at long")
    merged = stage(merged, "capture-index")
    # One row per range, so the window over all of them is small.
    sizes = merged.groupBy("range").agg(F.count("*").alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return merged.join(F.broadcast(bases), "range").withColumn("position", F.col("base") + F.col("at")).drop("range", "at", "base")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = merge_index(stage(read_captures(spark, path), "captures"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time", "position")


#: DuckDB SQL of the same rows.
OP6_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, encode(coalesce(html, '')) AS b,
         strftime(make_timestamp((1704067200 + coalesce(page_id, 0) % 315360000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time FROM pages),
d AS (
  SELECT *, octet_length(b) AS n, sha1(b) AS digest, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM p),
k AS (
  SELECT *, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM d),
f AS (
  SELECT *, CASE WHEN host = '' THEN ''
                 ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(r, '^[^/?#]*([^#]*)', 1) END AS url_key FROM k)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to, url_key, time,
       (row_number() OVER (ORDER BY url_key, time, page_id) - 1)::BIGINT AS position
FROM f
"""
