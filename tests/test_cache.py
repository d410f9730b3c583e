"""The chunk cache: look-ups by key, writers at once, damage, eviction."""

import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.plans import pipeline
from papyrion.session import scratch, stage
from papyrion.sources import cache

SCHEMA = "content_fp string, config_fp string, ord long, text string"


def rows(names, n=3, text="some text"):
    return [(name, "cfg", i, f"{text} of {name}, {i}") for name in names for i in range(n)]


def frame(spark, names, **more):
    return spark.createDataFrame(rows(names, **more), SCHEMA).repartition(3)


def held(spark, folder):
    return cache.ChunkCache(spark, f"file://{folder}/cache")


def listed(df):
    return sorted(tuple(r[c] for c in ("content_fp", "config_fp", "ord", "text")) for r in df.collect())


def files(folder, kind):
    return sorted(p for p in Path(folder, "cache", kind).rglob("*.parquet"))


def test_append_find_read_and_clear(spark, tmp_path):
    c = held(spark, tmp_path)
    keys = spark.createDataFrame([("a", "cfg", 1), ("z", "cfg", 2), (None, "cfg", 3)], "content_fp string, config_fp string, batch_id int")
    assert not c.exists() and c.read() is None and c.misses(keys).count() == 3 and c.find(keys).count() == 0
    c.append(frame(spark, "ab"))
    c.append(frame(spark, "bc", text="another text"))
    assert listed(c.read()) == sorted(rows("ab") + rows("c", text="another text"))
    assert [r.batch_id for r in c.misses(keys).orderBy("batch_id").collect()] == [2, 3]
    assert listed(c.read(keys)) == rows("a")
    before = c.manifest()
    c.append(frame(spark, "abc"))
    assert c.manifest() == before and len(files(tmp_path, "chunks")) == len(set(files(tmp_path, "chunks")))
    info = c.info().first()
    assert info.cache_files == 3 and info.total_size_mb == round(sum(len(r[3]) for r in rows("ab") + rows("c", text="another text")) / 1048576, 6)
    c.append(frame(spark, "abc").limit(0))
    c.clear()
    assert not c.exists() and c.info().first().cache_files == 0


def test_a_look_up_reads_keys_by_prefix_and_no_chunks(spark, tmp_path, monkeypatch):
    c = held(spark, tmp_path)
    c.append(frame(spark, [f"{i % 16:x}{i:031d}" for i in range(200)]))
    keys = frame(spark, ["3" + "0" * 31, f"5{5:031d}"]).select(*cache.KEY)
    for few in (1000, 0):  # by value, and by a join
        monkeypatch.setattr(cache, "FEW_KEYS", few)
        misses, found = c.misses(keys), c.find(keys)
        for df in (misses, found):
            assert df.inputFiles() and all("/cache/keys/" in name for name in df.inputFiles())
            plan = df._jdf.queryExecution().executedPlan().toString()
            if few:
                assert "PartitionFilters: [prefix" in plan and "In(content_fp" in plan
        assert {r.content_fp for r in misses.collect()} == {"3" + "0" * 31} and {r.content_fp for r in found.collect()} == {f"5{5:031d}"}
    import pyarrow.parquet as pq

    assert {p.parent.name for p in files(tmp_path, "keys")} == {f"prefix={i:x}" for i in range(16)}
    # Parquet's footer names a Bloom filter for the fingerprint alone.
    raw = files(tmp_path, "keys")[0].read_bytes()
    assert pq.ParquetFile(files(tmp_path, "keys")[0]).metadata.num_rows and len(raw) > 1 << 10


def test_two_writers_at_once_leave_each_entry_once(spark, tmp_path, monkeypatch):
    swap, gate, tries = cache.ChunkCache._swap, threading.Barrier(2, timeout=120), []

    def together(self, base, **changed):
        if base["version"] == 0:
            gate.wait()  # both have found nothing there
        done = swap(self, base, **changed)
        tries.append(done)
        return done

    monkeypatch.setattr(cache.ChunkCache, "_swap", together)
    errors = []

    def write(names):
        try:
            held(spark, tmp_path).append(frame(spark, names))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=write, args=(names,)) for names in ("abcd", "cdef")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors and sorted(tries) == [False, True, True]
    c = held(spark, tmp_path)
    assert listed(c.read()) == rows("abcdef") and c.manifest()["version"] == 2
    assert c.entries().groupBy(*cache.KEY).count().agg(F.max("count")).first()[0] == 1


def test_renames_of_other_stores_fail_if_the_target_is_there(spark, tmp_path):
    c = held(spark, tmp_path)
    (tmp_path / "one").write_text("1")
    (tmp_path / "two").write_text("2")
    (one, files_), (two, _) = c._hadoop(f"file://{tmp_path}/one"), c._hadoop(f"file://{tmp_path}/two")
    with pytest.raises(Exception, match="exists"):
        c._rename_new(files_, one, two)
    c._rename_new(files_, one, c._hadoop(f"file://{tmp_path}/three")[0])
    assert (tmp_path / "three").read_text() == "1" and (tmp_path / "two").read_text() == "2"


@pytest.mark.parametrize("damage", ["cut", "gone", "other"])
def test_damage_costs_the_entries_of_one_file_only(spark, tmp_path, damage):
    c = held(spark, tmp_path)
    for names in ("abc", "def"):
        c.append(frame(spark, names).coalesce(1))
    victim = files(tmp_path, "chunks")[0]
    lost = set(spark.read.parquet(f"file://{victim}").toPandas().content_fp)
    if damage == "cut":
        os.truncate(victim, victim.stat().st_size // 2)
        victim.with_name(f".{victim.name}.crc").unlink()
    elif damage == "gone":
        victim.unlink()
    else:  # readable, but one text is not what was written
        table = spark.read.parquet(f"file://{victim}").toPandas()
        table.loc[0, "text"] = "changed"
        lost = {table.loc[0, "content_fp"]}
        victim.with_name(f".{victim.name}.crc").unlink()
        table.to_parquet(victim)
    left = sorted(set("abcdef") - lost)
    assert listed(c.read()) == rows(left)
    assert {r.content_fp for r in c.misses(frame(spark, "abcdef")).collect()} == lost
    assert listed(c.read()) == rows(left)
    c.append(frame(spark, "abcdef"))
    assert listed(c.read()) == rows("abcdef")


def test_damaged_chunks_are_made_again(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "x " * 900), ("b", 0, "y " * 700), ("none", 0, None)], "batch_id string, page_no long, text string")
    c = held(spark, tmp_path)
    config = ChunkConfig(strategy="fixed")
    cold = sorted(map(tuple, pipeline.cached_chunks(pages, c, config).collect()), key=repr)
    for victim in files(tmp_path, "chunks"):
        os.truncate(victim, 40)
        victim.with_name(f".{victim.name}.crc").unlink()
    assert sorted(map(tuple, pipeline.cached_chunks(pages, c, config).collect()), key=repr) == cold and len(cold) > 2
    assert pipeline.cached_chunks(pages.limit(0), held(spark, tmp_path / "other"), config).count() == 0


def test_eviction_by_age_then_by_size_in_order_of_last_use(spark, tmp_path):
    c = held(spark, tmp_path)
    for i, name in enumerate("abcdef"):
        c.append(frame(spark, name, n=1, text="0123456789"), now=100 * i)
    size = len("0123456789 of a, 0")
    c.touch(frame(spark, "b"), now=900)
    c.touch(frame(spark, "bz"), now=700)
    gone = c.evict(max_age=750, max_bytes=3 * size, now=1000)
    got = {(r.content_fp, r.bytes, int(r.last_used.timestamp()), r.reason) for r in gone.withColumn("last_used", F.col("last_used")).collect()}
    # b was used last at 900; a and c are too old; of d, e, f and b, the first three of the most recent fit.
    assert {(n, b, r) for n, b, _, r in got} == {("a", size, "age"), ("c", size, "age"), ("d", size, "size")}
    assert {r[0] for r in listed(c.read())} == set("bef")
    assert c.evict().count() == 0 and c.evict(max_bytes=10**9, max_age=10**9, now=2000).count() == 0
    assert c.compact() and {r[0] for r in listed(c.read())} == set("bef")
    c.vacuum()
    assert {r[0] for r in listed(c.read())} == set("bef") and len(list(Path(tmp_path, "cache/chunks").glob("commit=*"))) == 3
    # The last uses are still known.
    assert {r.content_fp for r in c.evict(max_bytes=size).collect()} == set("ef")


def test_keys_are_put_together_after_many_appends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_FOLDERS", 3)
    c = held(spark, tmp_path)
    for name in "abcdef":
        c.append(frame(spark, name))
    assert len(c.manifest()["keys"]) <= 4 and listed(c.read()) == rows("abcdef")


def test_another_thread_stages_outside_of_a_block_of_work(spark):
    kept = []

    def work():
        kept.append(stage(spark.range(5), "beside"))

    with scratch(spark) as keep:
        thread = threading.Thread(target=work)
        thread.start()
        thread.join()
        inner = stage(spark.range(3), "inner")
        mine = keep(inner, "mine")
    assert kept[0].count() == 5 and mine.count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist|FAILED_READ"):
        inner.count()


def test_texts_are_read_once_for_keys_and_not_shuffled_for_digests(spark, tmp_path):
    from papyrion.plans import catalog

    # Only staged keys and the cache's own are read for the result, not the documents again.
    missed = catalog.empty_batches(spark, "/root/testdata/sf0.001")
    assert missed.count() > 0 and not [name for name in missed.inputFiles() if "documents" in name]
    c = held(spark, tmp_path)
    c.append(frame(spark, "abc"))
    chunks, wanted = c._chunks(c.manifest()["schema"]), c.entries().where("content_fp <> 'b'")
    seen = c._digest(chunks, wanted)
    assert {r.content_fp: r.n for r in seen.collect()} == {"a": 3, "c": 3}
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("xxhash64(")  # parents come first


def test_fingerprints_of_odd_lines(spark):
    import hashlib
    import re
    from random import Random

    from papyrion.functions import text as T

    assert set(T.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    draw = Random(5)
    letters = [*T.SPACES, "\r\n", "\n", "\r", "\n\r", "a", "é", "\u200b", "\U0001f600", "\ud7ff", "\ufeff"]
    texts = [None, "", "a" + " " * 100_000 + "b", *("".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(500))]
    want = [hashlib.md5("\n".join(x for line in re.split("\r\n?|\n", t or "") if (x := line.strip())).encode()).hexdigest() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i")
    got = df.select("text", T.content_fingerprint(F.col("text")).alias("fp"), T.strip(F.col("text")).alias("stripped")).collect()
    assert [r.fp for r in got] == want
    assert all(r.stripped == (None if r.text is None else r.text.strip()) for r in got)
