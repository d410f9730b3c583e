import hashlib
import io
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyrion.llm import warc


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


def test_round_trip_with_odd_rows(spark, tmp_path):
    random.seed(2)
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    rows = [(1, "http://A.example.com/x#f", big, "t"), (5, "http://b.example.com/", big, "t"), (None, "http://b.example.com/", big, "t"),
            (5, "http://b.example.com/", big, "t"), (2, None, None, "t"), (3, "no scheme", "small", "t"), (4, "http://c/\r\nX: y", "small", "t"), (9, "http://c/", "", "t")]
    rows += [(100 + i, f"http://h{random.randint(0, 3)}.org/{random.randint(0, 5)}", f"page {i % 7} " * 300, "t") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, time string").repartition(5)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    got = warc.merge_index(warc.read_captures(spark, path), ranges=3).collect()
    best = {}
    for p, _, h, _ in rows:
        if len((h or "").encode()) >= 1000 and p is not None:
            best[h] = max(p, best.get(h, p))
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        to = best.get(h) if len(raw) >= 1000 else None
        to = to if to is not None and (p is None or p < to) else None
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)
    assert "com,example,a)/x" in {r.url_key for r in got}
    empty = f"file://{tmp_path}/none"
    warc.write_archives(pages.limit(0), empty)
    assert warc.merge_index(warc.read_captures(spark, empty)).count() == 0


def test_records_can_be_read_alone_and_times_are_utc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    rows = [(i, f"http://h{i % 3}.org/{i}", f"é page {i} " * (40 * (i % 4)), None if i == 3 else 1_709_164_799 + i, "x") for i in range(30)]
    pages = spark.createDataFrame(rows, "id long, link string, body string, seen long, page_id string").selectExpr("id", "link", "body", "timestamp_seconds(seen) AS url", "page_id")
    path = f"file://{tmp_path}/warc"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        warc.write_archives(pages.coalesce(2), path, page="id", url="link", html="body", time="url")
        captured = warc.read_captures(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len({r.run for r in captured}) > 2 and sorted(r.page_id for r in captured) == list(range(30))
    for r in captured:
        with open(r.run.removeprefix("file://").removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            record = zlib.decompress(file.read(r.length), 31)
        ((headers, block),) = warc.read_records(io.BytesIO(record))
        assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert block.endswith(rows[r.page_id][2].encode()) or r.record_type == "revisit"
    times = {r.page_id: r.time for r in captured}
    assert times[0] == "2024-02-28T23:59:59Z" and times[1] == "2024-02-29T00:00:00Z" and times[3] == "2024-01-01T00:00:03Z"


def test_damaged_archives_are_noticed():
    good = zlib.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", 6, 31)
    assert [x[:2] for x in warc.read_members(memoryview(good + warc._EMPTY + good))] == [(0, len(good)), (len(good) + len(warc._EMPTY), len(good))]
    for bad in (good[:-9], good + good[:5]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_members(memoryview(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n")))


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    random.seed(7)
    rows = [(i, f"http://h.org/{i % 5}", "".join(random.choices("abcdefghij", k=random.choice([10, 400, 9000])))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    captured = warc.read_captures(spark, path).collect()
    assert sorted(r.page_id for r in captured) == list(range(60))
    by_run = {}
    for r in captured:
        by_run.setdefault(r.run, []).append(r)
    assert len(by_run) > 10
    for found in by_run.values():
        found.sort(key=lambda r: r.offset)
        assert len(found) == 1 or sum(r.length for r in found) <= 3000
        keys = [(r.url_key, r.time, r.page_id) for r in found]
        assert keys == sorted(keys)  # each archive is a run in order
    merged = sorted(warc.merge_index(warc.read_captures(spark, path), ranges=3).collect(), key=lambda r: r.position)
    assert [r.position for r in merged] == list(range(60))
    assert [(r.url_key, r.time, r.page_id) for r in merged] == sorted((r.url_key, r.time, r.page_id) for r in merged)


def test_captures_equal_in_every_key_spread_over_ranges(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr(
        "concat('run', id % 7) run", "cast(null as long) page_id", "'' url", "'2024-01-01T00:00:00Z' time", "'response' record_type", "cast(null as long) refers_to",
        "0L payload_bytes", "'' payload_digest", "id offset", "1L length", "'' url_key",
    )
    sizes, merge = [], warc.stage
    monkeypatch.setattr(warc, "stage", lambda df, name: (out := merge(df, name), sizes.extend(r["count"] for r in out.groupBy("range").count().collect()))[0])
    merged = warc.merge_index(rows.repartition(5), ranges=10)
    assert len(sizes) == 10 and max(sizes) < 6000
    got = merged.orderBy("position").select("position", "run", "offset").collect()
    assert [r.position for r in got] == list(range(20_000))
    assert [(r.run, r.offset) for r in got] == sorted((r.run, r.offset) for r in got)
