import time

from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.plans import measure, pipeline
from papyrion.sources.cache import ChunkCache
from papyrion.streaming.ingest import ingest, watch_pages

FIXED = ChunkConfig(strategy="fixed", size=50, overlap=5, min_size=10, max_size=80)


def test_numbers_of_a_run_equal_those_of_the_report(spark):
    rows = [(f"b{i % 3}", i, "some words " * (i % 40)) for i in range(90)] + [("one", 0, "alone"), ("none", 0, None)]
    pages = spark.createDataFrame(rows, "batch_id string, page_no long, text string")
    began = time.monotonic()
    chunks, seen = measure.run(pages, FIXED)
    assert 0 < seen.took_ms <= 1000 * (time.monotonic() - began) + 1
    report = pipeline.report(pages, chunks, FIXED, took_ms=seen.took_ms).collect()
    assert seen.n_chunks == sum(r.num_chunks for r in report) == chunks.count()
    n = F.length("text")
    assert (seen.n_chars, seen.least, seen.most, seen.n_enhanced) == tuple(chunks.agg(F.sum(n), F.min(n), F.max(n), F.count_if("enhanced")).first())
    assert sorted(map(tuple, chunks.collect()), key=repr) == sorted(map(tuple, pipeline.chunk(pages, FIXED).collect()), key=repr)
    empty, none = measure.run(pages.limit(0), FIXED)
    assert empty.count() == 0 and (none.n_chunks, none.n_chars, none.least, none.most, none.n_enhanced) == (0, 0, None, None, 0)


def test_a_stream_tells_of_its_pages(spark, tmp_path):
    for k in range(3):
        rows = [(f"b{k}", i, "text") for i in range(4 + k)]
        spark.createDataFrame(rows, "batch_id string, page_no long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    told = measure.Progress()
    spark.streams.addListener(told)
    try:
        stream = measure.observed(watch_pages(spark, f"{tmp_path}/in/*", files_per_trigger=1))
        ingest(stream, ChunkCache(spark, f"file://{tmp_path}/cache"), f"{tmp_path}/check", FIXED, once=True).awaitTermination(240)
        for _ in range(100):  # listeners are told a little later
            if told.n_pages >= 15:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    assert sorted(s[1] for s in told.steps if s[1]) == [4, 5, 6] and told.n_pages == 15
    assert all(s[2] == 4 * s[1] and s[3] > 0 for s in told.steps if s[1])
