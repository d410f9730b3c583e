"""Chunks kept by what they were made from, keyed by content and settings.

``compat`` keys take the batch's joined text and rounded settings, so that texts
which differ in blank lines or page bounds, and nearly equal settings, share an
entry. ``strict`` keys take each page and every setting; they are sums over the
pages, so a batch of any size is combined before the shuffle.

A cache (`ChunkCache`) has, under its path:

* ``chunks/commit=…``: the chunks that one append wrote;
* ``keys/…``: an entry of an append is one row: its key, where its chunks are, their number, digest and bytes, and when it
  was made. Keys lie in folders by the first digit of the content's fingerprint, sorted, with Bloom filters, so that
  looking up a few keys opens few pages; and a look-up of any size reads keys alone, never chunks;
* ``gone/…``: entries that were evicted or found damaged; ``uses/…``: when entries were read;
* ``manifest/N.json``: which folders of the above count. An append, eviction or removal writes its folders first and then
  the next manifest, under a number that only one writer can take; whoever comes too late looks again at what
  has changed. So readers see all of an append or nothing, and an entry is there once, however many write at a time.

Chunks are checked against number and digest as they are read. A damaged entry, or a file that cannot be read, costs
its own entries only: they become misses and are put aside.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import astuple, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.config import ChunkConfig
from papyrion.functions.text import config_fingerprint, content_fingerprint
from papyrion.session import stage
from papyrion.sources.pages import batch_text

KEY = ["content_fp", "config_fp"]
#: So many keys are looked up by value, which reaches the Bloom filters; more are joined.
FEW_KEYS = 1000
#: Folders of keys that are put together into one.
MOST_FOLDERS = 64
_ENTRIES = "content_fp string, config_fp string, prefix string, commit string, n long, x long, s long, bytes long, made timestamp"


def config_key(config: ChunkConfig, mode: str = "strict", embed: object = None):
    """``compat`` leaves the embedder out; ``strict`` names it (by its ``name``, or else its class), so that a model's chunks are not served to another."""
    if mode == "compat":
        return config_fingerprint(F.lit(config.strategy), F.lit(config.size), F.lit(config.overlap), F.lit(config.threshold))
    named = replace(config, embedder=config.embedder or (getattr(embed, "name", type(embed).__qualname__) if embed is not None else None))
    return F.md5(F.lit(repr(astuple(named))))


def batch_keys(pages: DataFrame, config: ChunkConfig, mode: str = "strict", embed: object = None) -> DataFrame:
    """(batch_id, content_fp, config_fp) of each batch."""
    if mode == "compat":
        return batch_text(pages).select("batch_id", content_fingerprint(F.col("text")).alias("content_fp"), config_key(config, mode).alias("config_fp"))
    h = F.xxhash64("page_no", F.coalesce("text", F.lit("")))
    hashed = pages.select("batch_id", h.alias("h"), F.xxhash64(h, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("low"))
    summed = hashed.groupBy("batch_id").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum("low").alias("s"))
    return summed.select("batch_id", F.md5(F.concat_ws("_", "n", "x", "s")).alias("content_fp"), config_key(config, mode, embed).alias("config_fp"))


def hits(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """``keys`` whose content and settings have chunks in ``cached``."""
    return keys.join(cached.select(*KEY).distinct(), KEY, "left_semi")


def misses(keys: DataFrame, cached: DataFrame) -> DataFrame:
    return keys.join(cached.select(*KEY).distinct(), KEY, "left_anti")


def info(cached: DataFrame) -> DataFrame:
    """(cache_files, total_size_mb): entries, and their texts in UTF-8."""
    by_entry = cached.groupBy(*KEY).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return _totals(by_entry)


def _totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("cache_files"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576, 6).alias("total_size_mb"))


def _time(now: float | None):
    return F.current_timestamp() if now is None else F.timestamp_seconds(F.lit(float(now)))


class ChunkCache:
    """Chunks (content_fp, config_fp, ord, sub, …, text) by entry at ``path``, for any number of writers and readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # The manifest

    def _hadoop(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, files = self._hadoop(f"{self.path}/manifest")
        if not files.exists(path):
            return []
        return sorted(int(name[:-5]) for s in files.listStatus(path) if (name := s.getPath().getName()).endswith(".json"))

    def manifest(self) -> dict:
        """``version``, the names of the folders of ``keys``, ``gone`` and ``uses`` that count, and the ``schema`` of chunks."""
        found = self._versions()
        if not found:
            return {"version": 0, "keys": [], "gone": [], "uses": [], "schema": None}
        path, files = self._hadoop(f"{self.path}/manifest/{found[-1]:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _swap(self, base: dict, **changed) -> bool:
        """Make ``base``, with changes, the next manifest, unless another writer has made one since."""
        made = base | changed | {"version": base["version"] + 1}
        written, files = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        target, _ = self._hadoop(f"{self.path}/manifest/{made['version']:012d}.json")
        files.mkdirs(written.getParent())
        stream = files.create(written)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        try:
            if files.getUri().getScheme() == "file":
                # A local rename would replace what is there; a link fails.
                os.link(written.toUri().getPath(), target.toUri().getPath())
            else:
                self._rename_new(files, written, target)
        except Exception:
            if made["version"] not in self._versions():
                raise
            return False
        finally:
            files.delete(written, False)
        for old in self._versions()[:-10]:
            files.delete(self._hadoop(f"{self.path}/manifest/{old:012d}.json")[0], False)
        return True

    def _rename_new(self, files, source, target) -> None:
        """A rename that fails if the target is there."""
        context = self.spark.sparkContext
        kinds = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = context._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename(source, target, options)

    # Entries

    def _table(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/of={n}" for n in names])

    def entries(self, manifest: dict | None = None) -> DataFrame:
        """One row per entry, as `_ENTRIES` names them."""
        manifest = manifest or self.manifest()
        found = self._table("keys", manifest["keys"], _ENTRIES)
        if not manifest["gone"]:
            return found
        return found.join(self._table("gone", manifest["gone"], "content_fp string, config_fp string, commit string"), [*KEY, "commit"], "left_anti")

    def find(self, keys: DataFrame, manifest: dict | None = None) -> DataFrame:
        """The entries of ``keys`` that are there. ``keys`` is read twice."""
        entries = self.entries(manifest)
        few = keys.select("content_fp").distinct().limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            names = sorted(r["content_fp"] for r in few if r["content_fp"] is not None)
            entries = entries.where(F.col("content_fp").isin(names) & F.col("prefix").isin(sorted({n[:1] for n in names})))
        return entries.join(keys.select(*KEY).distinct(), KEY, "left_semi")

    def misses(self, keys: DataFrame) -> DataFrame:
        """``keys`` that have no entry."""
        return keys.join(self.find(keys), KEY, "left_anti")

    def _write_keys(self, entries: DataFrame, name: str) -> None:
        # As many files a prefix as there are tasks that have rows of it: one for each, but for very many keys.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = entries.repartitionByRange(n, "prefix", "content_fp").sortWithinPartitions("prefix", "content_fp")
        dealt.write.option("parquet.bloom.filter.enabled#content_fp", "true").partitionBy("prefix").parquet(f"{self.path}/keys/of={name}")

    def _digest(self, chunks: DataFrame, entries: DataFrame | None = None) -> DataFrame:
        """Number, digest and bytes of each entry of ``chunks``, or of those that are in ``entries``."""
        columns = sorted(c for c in chunks.columns if c not in (*KEY, "commit"))
        h = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
        hashed = chunks.select(*KEY, "commit", h.alias("h"), F.octet_length("text").alias("b"))
        if entries is not None:
            # Hashes go to the join, and no texts, as they would if Spark put a semi-join before the hashing.
            hashed = hashed.join(entries.select("commit", *KEY).distinct(), ["commit", *KEY])
        return hashed.groupBy(*KEY, "commit").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))).alias("s"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))

    def append(self, chunks: DataFrame, now: float | None = None) -> None:
        """Put in the entries of ``chunks`` that are not there, all in one commit; the rest is left as it is."""
        if self.manifest()["keys"]:
            chunks = chunks.join(self.entries().select(*KEY).distinct(), KEY, "left_anti")
        commit = f"c{uuid.uuid4().hex}"
        folder = f"{self.path}/chunks/commit={commit}"
        chunks.write.parquet(folder)
        written = self.spark.read.parquet(folder).withColumn("commit", F.lit(commit))
        mine = stage(self._digest(written).select(*KEY, F.left("content_fp", F.lit(1)).alias("prefix"), "commit", "n", "x", "s", "bytes", _time(now).alias("made")), "cache-entries")
        while True:
            base = self.manifest()
            new = mine.join(self.entries(base).select(*KEY), KEY, "left_anti") if base["keys"] else mine
            if new.isEmpty():
                self._delete(f"chunks/commit={commit}")
                return
            name = f"c{uuid.uuid4().hex}"
            self._write_keys(new, name)
            # Kept, so that no file of chunks has to be whole for the others to be read.
            if self._swap(base, keys=[*base["keys"], name], schema=base["schema"] or written.schema.jsonValue()):
                break
            self._delete(f"keys/of={name}")
        if len(base["keys"]) >= MOST_FOLDERS:
            self.compact()

    def compact(self) -> bool:
        """Put all keys into one folder, and the uses into one with the last of each entry; False if another writer came first."""
        base = self.manifest()
        name = f"c{uuid.uuid4().hex}"
        self._write_keys(self.entries(base), name)
        self._last_uses(base).write.parquet(f"{self.path}/uses/of={name}")
        return self._swap(base, keys=[name], gone=[], uses=[name])

    # Chunks

    def _chunks(self, schema: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(schema)).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{self.path}/chunks")

    def read(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The chunks of ``keys``, or of all entries; None if there never was an entry. Damaged entries are left out and put aside."""
        manifest = self.manifest()
        if not manifest["schema"]:
            return None
        entries = stage(self.entries(manifest) if keys is None else self.find(keys, manifest), "wanted-entries")
        rows = self._chunks(manifest["schema"])
        seen = self._digest(rows, entries)
        good = stage(entries.join(seen.select("commit", *KEY, "n", "x", "s"), ["commit", *KEY, "n", "x", "s"], "left_semi"), "good-entries")
        bad = entries.join(good, ["commit", *KEY], "left_anti")
        if not bad.isEmpty():
            self._put_aside(bad)
        return rows.join(good.select("commit", *KEY), ["commit", *KEY], "left_semi").drop("commit")

    def _put_aside(self, entries: DataFrame) -> None:
        gone = stage(entries.select(*KEY, "commit"), "gone-entries")
        name = f"c{uuid.uuid4().hex}"
        gone.write.parquet(f"{self.path}/gone/of={name}")
        while not self._swap(base := self.manifest(), gone=[*base["gone"], name]):
            pass

    # Use and eviction

    def touch(self, keys: DataFrame, now: float | None = None) -> None:
        """Note that the entries of ``keys`` are used now."""
        name = f"c{uuid.uuid4().hex}"
        self.find(keys).select(*KEY, _time(now).alias("used")).write.parquet(f"{self.path}/uses/of={name}")
        while not self._swap(base := self.manifest(), uses=[*base["uses"], name]):
            pass

    def _last_uses(self, manifest: dict) -> DataFrame:
        return self._table("uses", manifest["uses"], "content_fp string, config_fp string, used timestamp").groupBy(*KEY).agg(F.max("used").alias("used"))

    def evict(self, max_age: float | None = None, max_bytes: int | None = None, now: float | None = None) -> DataFrame:
        """Take out entries not used for ``max_age`` seconds, then those used longest ago until the rest has at most ``max_bytes`` of text.

        Gives (content_fp, config_fp, bytes, last_used, reason) of what was taken out. Entries used at the same time go in the order of
        their keys, the greatest first. The running total is taken by ranges, so no task sees all entries.
        """
        base = self.manifest()
        known = self.entries(base).join(self._last_uses(base), KEY, "left")
        dated = known.select(*KEY, "commit", "bytes", F.greatest("made", "used").alias("last_used"))
        order = [F.col("last_used").desc(), F.col("content_fp"), F.col("config_fp")]
        old = F.lit(False) if max_age is None else F.col("last_used") < _time(now) - F.make_dt_interval(secs=F.lit(float(max_age)))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dated.withColumn("old", old).repartitionByRange(n, *order).sortWithinPartitions(*order)
        held = stage(dealt.withColumn("at", F.monotonically_increasing_id()), "cache-ages").withColumn("part", F.shiftright("at", 33))
        kept = F.when(F.col("old"), 0).otherwise(F.col("bytes"))
        # One row for each task.
        sums = held.groupBy("part").agg(F.sum(kept).alias("sum"))
        before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        total = F.col("base") + F.sum(kept).over(Window.partitionBy("part").orderBy("at"))
        summed = held.join(F.broadcast(before), "part").withColumn("total", total)
        over = F.lit(False) if max_bytes is None else F.col("total") > max_bytes
        reason = F.when(F.col("old"), "age").when(over, "size")
        out = stage(summed.withColumn("reason", reason).where("reason IS NOT NULL").select(*KEY, "commit", "bytes", "last_used", "reason"), "evicted")
        if not out.isEmpty():
            self._put_aside(out)
        return out.drop("commit")

    def vacuum(self) -> None:
        """Delete folders that no longer count: those of older manifests, and of appends that have no entry left. To be called when nobody else uses the cache."""
        manifest = self.manifest()
        for kind in ("keys", "gone", "uses"):
            for name in set(self._folders(kind, "of=")) - set(manifest[kind]):
                self._delete(f"{kind}/of={name}")
        commits = self._folders("chunks", "commit=")
        if commits:
            folders = self.spark.createDataFrame([(c,) for c in commits], "commit string")
            for row in folders.join(self.entries(manifest).select("commit").distinct(), "commit", "left_anti").toLocalIterator():
                self._delete(f"chunks/commit={row['commit']}")

    def _folders(self, kind: str, prefix: str) -> list[str]:
        path, files = self._hadoop(f"{self.path}/{kind}")
        if not files.exists(path):
            return []
        return [name.removeprefix(prefix) for s in files.listStatus(path) if (name := s.getPath().getName()).startswith(prefix)]

    def exists(self) -> bool:
        return bool(self._versions())

    def info(self) -> DataFrame:
        return _totals(self.entries()).withColumn("cache_dir", F.lit(self.path))

    def clear(self) -> None:
        path, files = self._hadoop(self.path)
        files.delete(path, True)

    def _delete(self, name: str) -> None:
        path, files = self._hadoop(f"{self.path}/{name}")
        files.delete(path, True)
