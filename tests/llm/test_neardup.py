import random

import pytest
from pyspark.sql import functions as F

from papyrion.llm import graph, licenses, neardup, tokenfiles, warc


def brute(texts, threshold=0.8):
    """{key: (class as the least key, links)} from every pair of different sets."""
    sets = {k: set(neardup.shingles(t).tolist()) for k, t in texts.items()}
    distinct = {}
    for k, s in sets.items():
        distinct.setdefault(frozenset(s), []).append(k)
    groups = [g for g in distinct if g]
    links = {g: [h for h in groups if h is not g and len(g & h) >= threshold * len(g | h)] for g in groups}
    out, seen = {}, set()
    for g in groups:
        if g in seen:
            continue
        stack, part = [g], []
        seen.add(g)
        while stack:
            x = stack.pop()
            part.append(x)
            for y in links[x]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        least = min(k for x in part for k in distinct[x])
        for x in part:
            for k in distinct[x]:
                out[k] = (least, len(links[x]))
    return {k: out.get(k, (k, 0)) for k in texts}


def test_banding_reaches_the_recall():
    bands, rows = neardup.banding()
    assert bands * rows <= neardup.HASHES and 1 - (1 - 0.8**rows) ** bands >= neardup.RECALL


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute(texts)


def test_blocks_and_odd_rows(spark, monkeypatch):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for group in (60, 3, 2, 1, 1):
        words = random.choices(vocabulary, k=150)
        for _ in range(group):
            copy = list(words)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(150)] = random.choice(vocabulary)
            rows.append((key, " ".join(copy), None, 0))
            key += 1
    rows += [(key, rows[0][1].upper() + "!", "x", 1), (key + 1, "", None, 0), (key + 2, None, None, 0), (key + 3, "two words", "a", 0), (key + 4, "Two words.", "b", 0)]
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, r int")
    want = brute({k: t for k, t, *_ in rows})
    got = neardup.classes(docs).collect()
    by_class = {}
    for r in got:
        by_class.setdefault(("alone", r.key) if r.class_node is None else r.class_node, []).append(r)
    assert {r.key: (min(x.key for x in rs), r.n_links) for rs in by_class.values() for r in rs} == want
    kept = neardup.drop_near_copies(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert [r.doc_id for r in neardup.drop_near_copies(nulls).collect()] == [4]


def test_few_long_texts_leave_blocks_empty(spark, monkeypatch):
    random.seed(7)
    rows = []
    for size in (2,) * 8 + (3,) * 4:
        words = [f"w{random.randrange(10**6)}" for _ in range(300)]
        for _ in range(size):
            copy = list(words)
            copy[random.randrange(300)] = "other"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 100)  # six blocks and more for two or three nodes
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.key: r.n_links for r in got} == {k: links for k, (_, links) in brute(dict(rows)).items()}


def test_rows_equal_in_key_and_text_are_one_node(spark, monkeypatch):
    random.seed(12)
    text = " ".join(random.choices("abcdefghijklmnop", k=300))
    near = text + " end"
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(16)
    rows = rows.unionByName(spark.createDataFrame([(7, near)], "doc_id long, text string"))
    held, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda grouped, threshold: (held.append(grouped.count()), confirmed(grouped, threshold))[1])
    found = neardup.classes(rows)
    assert held == [2]  # not one for each row
    got = {tuple(r): n for *r, n in found.groupBy("key", "n_copies", "n_links").count().collect()}
    assert got == {(None, 100_000, 1): 100_000, (7, 1, 1): 1}
    assert found.select("class_node").distinct().count() == 1
    kept = neardup.drop_near_copies(rows).collect()
    assert [tuple(r) for r in kept] == [(7, near)]


def test_ids_that_are_no_numbers_are_refused_before_a_job(spark):
    rows = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    for use in (neardup.classes, licenses.scan_licenses, lambda r: tokenfiles.write_token_files(r, "nowhere"), lambda r: warc.captures(r, page="doc_id", url="text", html="text")):
        with pytest.raises(TypeError, match="whole numbers"):
            use(rows)
