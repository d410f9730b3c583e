"""The vector index and retrieval within batches, against every pair."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrion.config import RetrievalConfig
from papyrion.operators import vector_index, vectors
from papyrion.plans import catalog, pipeline


def plain(rows, asked, k, of=lambda batch: None):
    """{(batch, query): [(id, distance)]} from every pair; rows are (id, vector, batch)."""
    out = {}
    for q, a, b in asked:
        found = sorted((round(float(((np.array(v) - np.array(a)) ** 2).sum()), 9), i) for i, v, c in rows if of(b) == of(c))
        out.setdefault((of(b), q), []).extend((i, d) for d, i in found[:k])
    return out


def plan_of(df):
    return df._jdf.queryExecution().toString()


def got(near, batch=None):
    out = {}
    for r in near.collect():
        out.setdefault((r[batch] if batch else None, r.query_id), []).append((r["rank"], r.vec_id, r.distance))
    return {key: [x[1:] for x in sorted(found)] for key, found in out.items()}


def same(found, want):
    assert found.keys() == {k for k, v in want.items() if v}
    for key in found:
        assert [i for i, _ in found[key]] == [i for i, _ in want[key]], key
        assert [d for _, d in found[key]] == pytest.approx([d for _, d in want[key]], abs=1e-6)


@pytest.fixture(scope="module")
def hot():
    """Clusters, and one vector that a third of all rows have."""
    random = np.random.default_rng(3)
    middles = random.normal(size=(12, 8)) * 4
    rows = [(i, (middles[i % 12] + random.normal(size=8)).round(3).tolist(), "abc"[i % 3] if i % 7 else None) for i in range(800)]
    return rows + [(10_000 + i, [1.0] * 8, "a") for i in range(400)]


SCHEMA = "vec_id long, embedding array<double>, batch_id string"


@pytest.mark.parametrize("block", [7, 4096])
def test_index_against_every_pair(spark, hot, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    monkeypatch.setattr(vector_index, "HELD_QUERIES", block * 3)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", block)
    odd = [(None, [0.0] * 8, "a"), (5_000, None, "a")]
    table = spark.createDataFrame(hot + odd, SCHEMA).repartition(5)
    asked = [r for r in hot if r[0] % 40 == 0]
    queries = spark.createDataFrame(asked + odd, SCHEMA)
    index = vector_index.build_index(table)
    assert 1 <= index.probes <= len(index.centres) <= 34
    same(got(vector_index.search(index, queries, exact=True)), plain(hot, asked, 5))
    again = vector_index.open_index(spark, index.path)
    assert again.probes == index.probes and (again.centres == index.centres).all()
    near = vector_index.search(again, queries)
    want, found = plain(hot, asked, 5), got(near)
    assert sum(len({i for i, _ in found[k]} & {i for i, _ in want[k]}) for k in want) >= 0.9 * 5 * len(want)
    for df in (near, vector_index.search(again, queries, exact=True)):
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)
    # With every cell read, codes alone decide what is compared.
    all_cells = got(vector_index.search(again, queries, probes=len(index.centres)))
    assert sum(len({i for i, _ in all_cells[k]} & {i for i, _ in want[k]}) for k in want) >= 0.97 * 5 * len(want)


def test_a_hot_cell_is_many_blocks_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    table = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") < 3).cast("double")).alias("embedding"))
    index = vector_index.build_index(table, cells=2)
    blocks = spark.read.parquet(f"{index.path}/codes").select("cell", F.octet_length("ids").alias("n"), F.input_file_name().alias("file"))
    assert blocks.agg(F.max("n")).first()[0] == 50 * 8 and blocks.groupBy("cell").agg(F.countDistinct("file").alias("f")).agg(F.max("f")).first()[0] >= 3
    near = got(vector_index.search(index, table.where("vec_id IN (0, 1999)"), exact=True))
    assert [i for i, _ in near[None, 0]] == [0, 1, 2, 3, 4] and [i for i, _ in near[None, 1999]] == [3, 4, 5, 6, 7]


def test_small_and_empty_indexes(spark):
    one = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for exact in (False, True):
        assert got(vector_index.search(vector_index.build_index(one), one, exact=exact)) == {(None, 1): [(1, 0.0)]}
        assert vector_index.search(vector_index.build_index(one.limit(0)), one, exact=exact).count() == 0
        assert vector_index.search(vector_index.build_index(one), one.limit(0), exact=exact).count() == 0
    four = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)] + [(2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert got(vector_index.search(vector_index.build_index(four), four.where("vec_id = 0"), exact=True)) == {(None, 0): [(0, 0.0), (1, 1.0), (2, 4.0), (2, 4.0)]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    d = f"/root/testdata/{sf}"
    exact = {(r.query_id, r.vec_id) for r in catalog.vector_topk_batch(spark, d).collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.vector_topk_ann(spark, d).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("block", [5, 4096])
def test_retrieval_within_batches(spark, hot, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    asked = [r for r in hot if r[0] % 50 == 0] + [(0, [9.0] * 8, "b"), (1, [9.0] * 8, "nowhere")]
    table = spark.createDataFrame(hot + [(None, [0.0] * 8, "a"), (5_000, None, "a")], SCHEMA).repartition(6)
    near = vectors.top_k_in_batches(table, spark.createDataFrame(asked, SCHEMA), RetrievalConfig(block=block))
    want = plain(hot, asked, 5, of=lambda b: b)
    same(got(near, "batch_id"), want)
    batch_of = {i: b for i, _, b in hot}
    assert all(batch_of[r.vec_id] == r.batch_id for r in near.collect())
    assert "CartesianProduct" not in plan_of(near) and "NestedLoop" not in plan_of(near)
    assert vectors.top_k_in_batches(table.limit(0), table).count() == 0 and vectors.top_k_in_batches(table, table.limit(0)).count() == 0


def test_answers_from_the_question_s_own_batch(spark):
    from papyrion.operators.split import HashEmbedder

    passages = spark.createDataFrame([(i, f"{w} word", b) for i, (w, b) in enumerate([("red", "x"), ("blue", "x"), ("red", "y"), ("green", None)])], "vec_id long, text string, batch_id string")
    questions = spark.createDataFrame([(1, "red", "y"), (2, "blue", "x"), (3, "red", None), (4, "red", "none")], "query_id long, question string, batch_id string")
    made = pipeline.answer(questions, passages, HashEmbedder(), lambda prompts: prompts, scope="batch_id").collect()
    assert {r.query_id: r.context for r in made} == {1: "red word", 2: "blue word\n\nred word", 3: "green word", 4: ""}


def test_an_empty_table_has_no_nearest(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in ("vector_topk", "vector_topk_batch", "vector_topk_ann", "vector_topk_indexed", "vector_topk_in_batch"):
        assert catalog.QUERIES[query](spark, str(tmp_path)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_packed_once_and_compared_by_one_worker_a_task(spark):
    rows = [(i, [float(i % 7), float(i % 5)], i % 2) for i in range(300)]
    found = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert _plan(vectors.top_k_batch(found, found)).count("MapInArrow") == 1
    assert _plan(vectors.top_k_in_batches(found, found, batch="label")).count("MapInArrow") == 1


def test_the_embedder_gets_a_bounded_number_of_texts(spark):
    def sizes(texts):
        return np.full((len(texts), 1), float(len(texts)))

    made = vectors.embed_texts(spark.range(3000).selectExpr("id", "'a' AS text").coalesce(1), sizes)
    assert made.count() == 3000
    assert max(r.embedding[0] for r in made.collect()) <= 512


def test_rows_of_a_shelf_in_any_order_make_one_block_a_cell():
    cells = [i % 3 for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 30, pa.int32()), pa.array(cells, pa.int32()), pa.array(range(30), pa.int64()), pa.array([[float(i)] for i in range(30)])], ["shelf", "cell", "vec_id", "vector"])
    made = pa.Table.from_batches(vector_index._packed_rows(iter([batch]))).to_pylist()
    assert [r["cell"] for r in made] == [0, 1, 2]
    for r in made:
        ids = np.frombuffer(r["v_ids"], np.int64)
        assert ids.tolist() == [i for i in range(30) if i % 3 == r["cell"]] and np.frombuffer(r["v_data"]).tolist() == ids.tolist()
