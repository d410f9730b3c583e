import random

import pytest
from pyspark.sql import functions as F

from papyrion.llm import urls


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


@pytest.mark.parametrize("level_bytes", [1 << 20, 64])
def test_cascades_are_exact_over_the_universe(spark, level_bytes):
    names = [f"h{i}.org" for i in range(600)]
    listed = random.Random(1).sample(names, 150)
    made = urls.build_cascades(keys(spark, [*listed, None, listed[0]]), keys(spark, [*names, None, names[0]]), first=0.3, level_bytes=level_bytes)
    assert (len(made) > 1) == (level_bytes == 64)
    assert all(level.bits // 8 <= level_bytes for c in made for level in c.levels)
    assert max(len(c.levels) for c in made) > 1
    got = set()
    for k, c in enumerate(made):
        mine = keys(spark, names).where(urls.shard(F.col("key"), len(made)) == k)
        got |= {r.key for r in mine.where(c.contains(F.col("key"))).collect()}
    assert got == set(listed)


def test_an_empty_list_or_universe(spark):
    assert [c.levels for c in urls.build_cascades(keys(spark, []), keys(spark, ["a"]))] == [()]
    assert len(urls.build_cascades(keys(spark, ["a"]), keys(spark, []))[0].levels) == 1


PAGES = [
    (1, "http://Bad.Example.org/x?y#z", "k", "r"), (1, "http://Bad.Example.org/x?y#z", "k", "r"), (2, None, None, None), (None, "no scheme", "", ""), (3, "http://a.b.bad.example.org", "", ""),
    (4, "http://notbad.example.org/", "", ""), (5, "https://de.example.com/en/a", "", ""), (6, "https://www.example.com/en/a", "", ""), (7, "https://example.com/fr", "", ""), (8, "ftp://x.net/fr/#", "", ""),
    (9, "http://", "", ""), (10, "http:///p", "", ""), (11, "http://ÀB.net/es/é", "", ""), (12, "http://casino.com/", "", ""), (13, "http://" + "a." * 5000 + "bad.example.org", "", ""),
]


@pytest.mark.parametrize("level_bytes", [1 << 20, 8])
def test_verdicts_with_odd_rows_and_clashing_names(spark, level_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, __row string, __listed string").withColumn("url_verdict", F.lit(1))
    listed = keys(spark, [" BAD.example.org ", None, "", "casino.com", "never.seen"] + [f"more{i}.org" for i in range(30)])
    made = urls.judge_urls(pages, listed, level_bytes=level_bytes)
    assert made.columns == ["page_id", "url", "__row", "__listed", "url_verdict"]
    got = [(r.page_id, r.url_verdict.host[-16:], r.url_verdict.path, r.url_verdict.rule, r.url_verdict.listed, r.url_verdict.verdict) for r in made.collect()]
    bad = (1, "bad.example.org", "/x", None, True, "block")
    want = [
        bad, bad, (2, "", "", None, False, "allow"), (None, "", "", None, False, "allow"), (3, ".bad.example.org", "", None, True, "block"),
        (4, "tbad.example.org"[-16:], "/", None, False, "allow"), (5, "de.example.com", "/en/a", "example.com/en/", False, "block"),
        (6, "www.example.com"[-16:], "/en/a", "www.example.com/en/", False, "allow"), (7, "example.com", "/fr", "com/", False, "allow"),
        (8, "x.net", "/fr/", "net/fr/", False, "block"), (9, "", "", None, False, "allow"), (10, "", "/p", None, False, "allow"),
        (11, "Àb.net", "/es/é", "net/es/", False, "block"), (12, "casino.com", "/", "com/", True, "allow"), (13, ".bad.example.org", "", None, True, "block"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert urls.judge_urls(pages.limit(0), listed, level_bytes=level_bytes).count() == 0
    assert {r.url_verdict.listed for r in urls.judge_urls(pages, listed.limit(0)).collect()} == {False}


def test_no_python_on_the_way(spark):
    plan = urls.op10_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan.split("== Physical Plan ==")[1]
