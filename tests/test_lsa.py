"""The fitted embedder against a dense decomposition, and by what it finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.operators import lsa, vectors
from papyrion.operators.split import semantic_chunks
from papyrion.plans import catalog
from papyrion.sources import cache


def test_axes_are_those_of_a_dense_decomposition(spark):
    dice = random.Random(1)
    topics = [[f"w{t}x{i}" for i in range(12)] for t in range(4)]
    texts = [" ".join(dice.choices(topics[k % 4], k=30) + dice.choices(topics[0], k=5)) for k in range(120)] + ["", None, "alone"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "vec_id long, text string").repartition(5)
    fitted = lsa.fit_embedder(rows, dims=4, terms=256, passes=8)
    dense = np.zeros((len(texts), 256))
    for k, t in enumerate(texts):
        at, weights = fitted.row(t)
        dense[k, at] = weights
    df = (dense > 0).sum(axis=0)
    assert fitted.idf == pytest.approx(np.log((1 + len(texts)) / (1 + df)) + 1)
    assert np.abs((dense * dense).sum(axis=1) - np.array([bool(t) for t in texts])).max() < 1e-12
    _, s, vt = np.linalg.svd(dense)
    assert fitted.weights == pytest.approx(s[:4], rel=1e-6)
    for k in range(4):
        assert abs(fitted.axes[:, k] @ vt[k]) == pytest.approx(1, abs=1e-6)
        assert fitted.axes[np.abs(fitted.axes[:, k]).argmax(), k] > 0
    assert fitted(["", "unheard of", texts[0]])[0].tolist() == [0] * 4
    again = lsa.fit_embedder(rows.repartition(2), dims=4, terms=256, passes=8)
    assert again.axes == pytest.approx(fitted.axes, abs=1e-8)


def test_few_and_no_texts(spark):
    one = spark.createDataFrame([("a b",)], "text string")
    fitted = lsa.fit_embedder(one, dims=3, terms=64)
    assert fitted.weights == pytest.approx([1, 0, 0], abs=1e-6) and np.abs(fitted(["a b"])).max() == pytest.approx(1)
    none = lsa.fit_embedder(one.limit(0), dims=3, terms=64)
    assert none(["a b"]).tolist() == [[0, 0, 0]]


def test_planted_near_copies_are_among_the_nearest(spark):
    dice = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300").select("doc_id", "text").collect()
    planted = []
    for d in docs[::20]:
        words = d.text.split()
        planted.append((1_000_000 + d.doc_id, " ".join(dice.choice(words) if dice.random() < 0.15 else w for w in words)))
    texts = spark.createDataFrame([(d.doc_id, d.text) for d in docs] + planted, "vec_id long, text string")
    found = vectors.embed_texts(texts, lsa.fit_embedder(texts)).cache()
    near = vectors.top_k_batch(found, found.where("vec_id >= 1000000"), vectors.RetrievalConfig(k=6))
    hit = near.where(F.col("vec_id") == F.col("query_id") - 1_000_000).count()
    assert hit >= 0.9 * len(planted), (hit, len(planted))


def test_it_serves_chunks_and_cache_keys(spark):
    rows = spark.createDataFrame([("red sky. blue sea.",), ("green grass! red rose.",)], "text string")
    one, other = (lsa.fit_embedder(rows, dims=2, terms=64, seed=1), lsa.fit_embedder(rows.limit(1), dims=2, terms=64))
    text = "red sky. red rose. blue sea! green grass? green rose."
    assert " ".join(t for _, t in semantic_chunks(text, one, ChunkConfig(min_size=0))) == text
    key = lambda e: spark.range(1).select(cache.config_key(ChunkConfig(strategy="semantic"), "strict", e)).first()[0]
    assert key(one) != key(other) and key(one) == key(one)


def test_the_query_finds_each_document_itself_first(spark):
    rows = catalog.nearest_documents(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    first = {r.query_id: r for r in rows if r["rank"] == 1}
    assert set(first) == {d for d in docs if d % 100 == 0} and len(rows) == 5 * len(first)
    assert all(r.distance == 0 and docs[r.vec_id].lower().split() == docs[r.query_id].lower().split() for r in first.values())


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    held, stage = [], lsa.stage

    def spy(df, name, **more):
        held.append(df.columns)
        return stage(df, name, **more)

    monkeypatch.setattr(lsa, "stage", spy)
    made = lsa.fit_embedder(spark.createDataFrame([(f"word{i % 7} other{i % 3}",) for i in range(40)], "text string"), dims=4, passes=2)
    # The counts serve for the weights of words as well as for the passes.
    assert held == [["at", "counts"]]
    assert made.axes.shape == (lsa.TERMS, 4)
