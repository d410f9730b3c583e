import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from papyrion.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k : k + m]) for m in range(1, n + 1) for k in range(len(words) - m + 1)]


def plain(docs, bench, n=1, buckets=10_000, percent=10, least=20):
    count = lambda texts: Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, n)[1])
    s, t = count(x for _, x in docs), count(bench)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        words, found = features(text, n)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    there = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = there[: percent * len(there) // 100]
    ranked = [(*r, k) for k, r in enumerate(drawn, 1)]
    left = Counter(rows) - Counter(drawn)
    return sorted(ranked + [(*r, None) for r in left.elements()], key=repr)


def test_query_against_plain_counts(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in resampling.op11_importance_resampling(spark, d).collect()), key=repr)
    assert got == sorted(((k, f, w, s, r) for k, _, f, w, s, r in plain(docs, bench)), key=repr)


@pytest.mark.parametrize("accuracy", [1, 3, 10_000])
def test_odd_rows_ties_and_rough_sketches(spark, accuracy):
    random.seed(6)
    text = lambda: " ".join(random.choices("Ab c dé 12 ef".split(), k=random.randint(0, 60)))
    docs = [(i, text()) for i in range(150)] + [(None, "x " * 30), (None, "x " * 30), (None, None), (500, ""), (501, None)]
    docs += [(600, "b " * 40)] * 120  # equal in score and id, and more than there is room for
    bench = ["ab 12 ef", None, "", "b b b"]
    table = spark.createDataFrame([(k, t, 0, "s") for k, t in docs], "doc_id long, text string, rank int, score string").repartition(7)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    for percent in (1, 10, 40, 100):
        found = resampling.resample(table, target, ngram=2, buckets=50, percent=percent, accuracy=accuracy)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(docs, bench, 2, 50, percent)
    assert resampling.resample(table.limit(0), target).count() == 0
    assert resampling.resample(table.where("text = ''"), target.limit(0)).first()["rank"] is None


def test_the_bracket_is_confirmed_by_counts_and_widened(spark):
    rows = spark.range(10_000).select(F.col("id").alias("score"))
    for wanted in (1, 2, 777, 9_999, 10_000):
        for accuracy in (1, 2, 50, 10_000):
            low, high, above = resampling.bracket(rows, wanted, 10_000, accuracy=accuracy)
            assert low <= 10_000 - wanted <= high and above == 9_999 - high
    low, high, above = resampling.bracket(rows, 5_000, 10_000)
    assert high - low <= 10  # only a thousandth is left to sort
