import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from papyrion.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    """{doc: (words, hit words, items)} by trying every place."""
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((key, len(w), len(hit), sorted(items)))
    return out


def check(rows, want):
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]
    made = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want]
    assert sorted(got, key=repr) == sorted(made, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    check(decontam.op9_decontamination(spark, d).collect(), brute(docs, bench))


def test_small_segments_blocks_and_odd_rows(spark, tmp_path):
    random.seed(1)
    text = lambda n: " ".join(random.choice("abC") for _ in range(n))
    docs = [(i, text(random.randint(0, 60))) for i in range(40)] + [(None, None), (3, ""), (5, "Ünï-Code x"), (5, "Ünï-Code x")]
    bench = [(i, text(random.randint(0, 14))) for i in range(12)] + [(12, "ünï code"), (13, None), (14, "?!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    b = spark.createDataFrame(bench, "item_id long, text string")
    index = decontam.build_index(spark.read.parquet(f"{tmp_path}/documents.parquet"), segment=100)
    for block in (1, 40, 1 << 20):
        found = decontam.search(index, b, block=block, slop=0)
        rows = found.selectExpr("doc_id", "n_words", "hits", "items").collect()
        got = [(r.doc_id, r.n_words, sum(y - x for x, y in r.hits), sorted(r.items)) for r in rows]
        assert sorted(got, key=repr) == sorted(brute(docs, bench), key=repr)
    kept = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b)
    clean = [d for d, (_, _, hit, _) in zip(docs, brute(docs, bench)) if not hit]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(clean, key=repr)
    assert decontam.contamination(kept.limit(0), b).count() == 0
    assert decontam.contamination(kept, b.limit(0)).selectExpr("max(size(hits))").first()[0] == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {item} y"), (2, "one two three EXTRA four five six seven eight nine ten"), (3, "ten nine eight seven six five"), (4, "two one " + item[8:])]
    got = {r.doc_id: (r["items"], r["near_items"]) for r in decontam.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (["7"], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: ([], ["7"])}


def test_repeated_and_null_items_at_one_block_and_at_several(spark, tmp_path):
    a, b, c = ("alpha beta gamma", "delta epsilon zeta", "eta theta iota")
    docs = [(1, f"{a} x {b} y {c}"), (2, f"{c} z"), (3, "nothing here")]
    bench = [("p", a), ("p", b), (None, c), ("q", a), ("p", a), (None, c)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.createDataFrame(bench, "item_id string, text string").coalesce(1)
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    index = decontam.build_index(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    for block in (1, 50, 1 << 20):
        found = decontam.search(index, table, block=block).collect()
        assert {r.doc_id: (sorted(r["items"]), sorted(r.near_items)) for r in found} == {1: (["p", "q"], ["p", "q"]), 2: ([], []), 3: ([], [])}
        assert {r.doc_id: len(r.hits) for r in found} == {1: 3, 2: 1, 3: 0}
    got = {r.doc_id: (r.n_items, r.items_sha256, r.contaminated, r.n_near_items) for r in decontam.op9_decontamination(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (2, sha("p,q"), True, 2), 2: (0, sha(""), True, 0), 3: (0, sha(""), False, 0)}


def brute_near(words_of_doc, window, slop):
    """Is there a start from which each word is at most ``slop`` off its place?"""
    n = len(words_of_doc)
    return any(
        all(window[k] in words_of_doc[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k in range(len(window))) for s in range(-slop, n + slop)
    )


def test_proximity_against_every_start(spark):
    random.seed(8)
    docs = [(i, " ".join(random.choices("abcdefgh", k=random.randint(0, 40)))) for i in range(60)]
    bench = [(i, " ".join(random.choices("abcdefgh", k=random.randint(1, 6)))) for i in range(25)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    for segment in (1, 100, 1 << 18):
        index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), segment=segment)
        got = {int(r.doc_id): sorted(r.near_items) for r in decontam.search(index, table, slop=2).collect()}
        assert got == {d: sorted(str(i) for i, b in bench if brute_near(t.split(), b.split(), 2)) for d, t in docs}


def test_names_that_clash_when_rows_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "d e f", None, None)], "doc_id long, text string, row string, name string")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, "A b, c!")], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "d e f", None, None)]


def test_repeated_and_nameless_documents_at_one_block_and_at_several(spark):
    docs = [(1, "alpha beta gamma delta x")] * 2 + [(None, "alpha beta gamma delta"), (None, "delta gamma beta alpha")] * 2 + [(1, "delta gamma y"), (None, None)]
    bench = [("p", "alpha beta"), ("q", "gamma beta alpha"), ("r", "delta gamma")]
    table = spark.createDataFrame(bench, "item_id string, text string").coalesce(1)
    for partitions in (1, 2, 5):
        for segment in (1, 1 << 18):
            index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions), segment=segment)
            for block in (1, 40, 1 << 20):
                rows = decontam.search(index, table, block=block, slop=0).collect()
                got = [(r.doc_id, r.n_words, sum(y - x for x, y in r.hits), sorted(r["items"])) for r in rows]
                assert sorted(got, key=repr) == sorted(brute(docs, bench), key=repr)


def test_slices_of_windows_and_starts_change_nothing(spark, monkeypatch):
    random.seed(9)
    docs = [(i, " ".join(random.choices("abcdef", k=random.randint(0, 80)))) for i in range(40)]
    table = spark.createDataFrame([(i, " ".join(random.choices("abcdef", k=random.randint(1, 14)))) for i in range(30)], "item_id long, text string")
    phrases = decontam.Phrases([(r.item_id, r.text) for r in table.collect()])
    segment = decontam._segment(0, [d for d, _ in docs], [t.encode().split() for _, t in docs])
    once = decontam.search_segment(segment, phrases, 2)
    for windows, starts in ((1, 1), (7, 13), (1000, 40)):
        monkeypatch.setattr(decontam, "SLICE_WINDOWS", windows)
        monkeypatch.setattr(decontam, "SLICE_STARTS", starts)
        assert decontam.search_segment(segment, phrases, 2) == once


LARGE_BLOCK = """
import random, resource
from papyrion.llm import decontam
random.seed(1)
words = [f"w{i}" for i in range(40)]
phrases = decontam.Phrases([(i, " ".join(random.choices(words, k=2000))) for i in range(1400)])
assert sum(map(len, phrases.windows.values())) > 2_500_000
text = [" ".join(random.choices(words, k=1 << 16)).encode().split() for _ in range(4)]
segment = decontam._segment(0, [1, 2, 3, 4], text)
phrases.windows[10] = phrases.windows[10][:4_000]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
decontam.search_segment(segment, phrases, 2)
print(max(before, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
"""


def test_memory_of_a_whole_block_of_the_benchmark():
    """8 MB of benchmark, and a segment in which every window has thousands of candidates."""
    run = subprocess.run([sys.executable, "-c", LARGE_BLOCK], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300, check=True)
    assert int(run.stdout) < 1200


def test_a_task_holds_few_segments_at_once(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20) for i in range(60)], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(docs, segment=20)
    assert index.count() > 10 * decontam.ROW_GROUP
    for file in index.inputFiles():
        about = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        assert all(about.row_group(k).num_rows <= decontam.ROW_GROUP for k in range(about.num_row_groups))
