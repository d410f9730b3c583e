"""Chunks by meaning sentence by sentence, against the splitter that sees a page whole."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.operators import long_pages
from papyrion.operators.split import HashEmbedder, fixed_chunks, semantic_chunks
from papyrion.plans import pipeline

WORDS = "red blue sea sky night day ant bee cat dog".split()


def text_of(dice, sentences):
    return " ".join(" ".join(dice.choices(WORDS, k=dice.choice((0, 1, 2, 5)))) + dice.choice(".?! ") for _ in range(sentences))


def got(made):
    found = {}
    for r in made.collect():
        found.setdefault((r.batch_id, r.page_no), []).append((r.piece, r.start_index, r.failed, r.text))
    return {k: sorted(v) for k, v in found.items()}


def want(text, config, embed):
    return [(i, at, False, t) for i, (at, t) in enumerate(semantic_chunks(text or "", embed, config))]


@pytest.mark.parametrize(
    "block, buffer, least, threshold", [(1, 1, 30, 85), (40, 1, 30, 85), (1 << 18, 1, 30, 85), (40, 0, 0, 50), (1, 2, 200, 0), (300, 1, 10, 100), (1, 3, 1, 33.3), (40, 3, 1, 33.3)]
)
def test_blocks_of_any_size_give_the_same_chunks(spark, block, buffer, least, threshold):
    dice = random.Random(f"{buffer}{least}")
    config = ChunkConfig(strategy="semantic", buffer=buffer, min_size=least, threshold=threshold)
    rows = [("a", i, text_of(dice, n)) for i, n in enumerate((0, 1, 2, 3, 40, 90))] + [("b", None, None), (None, 1, ""), ("a", 4, "same. Page! Twice?")]
    pages = spark.createDataFrame(rows, "batch_id string, page_no long, text string").repartition(3)
    found = got(long_pages.semantic_chunks_of(pages, config, HashEmbedder(), block))
    expected = {}
    for b, p, t in rows:
        expected[b, p] = sorted(expected.get((b, p), []) + want(t, config, HashEmbedder()))
    assert found == expected


class Picky(HashEmbedder):
    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return super().__call__(texts)


def test_a_page_with_a_block_that_fails_is_cut_as_a_whole(spark):
    dice = random.Random(1)
    good, bad = text_of(dice, 50), text_of(dice, 30) + " A bad one. " + text_of(dice, 30)
    config = ChunkConfig(strategy="semantic", size=100, overlap=10, min_size=20)
    pages = spark.createDataFrame([("g", 0, good), ("b", 0, bad)], "batch_id string, page_no long, text string")
    found = got(long_pages.semantic_chunks_of(pages, config, Picky(), 100))
    assert found["g", 0] == want(good, config, HashEmbedder())
    assert found["b", 0] == [(i, at, True, t) for i, (at, t) in enumerate(fixed_chunks(bad, 100, 10))]
    assert long_pages.semantic_chunks_of(pages.limit(0), config, Picky()).count() == 0


def test_a_page_of_very_many_sentences_is_the_work_of_many_tasks(spark):
    dice = random.Random(2)
    text = text_of(dice, 60_000)
    pages = spark.createDataFrame([("a", 0, text)], "batch_id string, page_no long, text string")
    blocks = []
    kept = long_pages.stage
    long_pages.stage = lambda df, name: (out := kept(df, name), blocks.append(out) if name == "sentence-blocks" else None)[0]
    try:
        made = long_pages.semantic_chunks_of(pages, ChunkConfig(strategy="semantic"), HashEmbedder(), 1 << 15)
    finally:
        long_pages.stage = kept
    sizes = blocks[0].withColumn("task", F.input_file_name()).groupBy("task").agg(F.sum("own").alias("n")).collect()
    assert len(sizes) >= 4 and max(r.n for r in sizes) < 30_000
    assert got(made)["a", 0] == want(text, ChunkConfig(strategy="semantic"), HashEmbedder())


def test_the_pipeline_gives_long_pages_to_many_tasks(spark, monkeypatch):
    dice = random.Random(4)
    rows = [("a", 0, text_of(dice, 30)), ("a", 1, text_of(dice, 120)), ("a", 2, "x"), ("b", 0, text_of(dice, 90)), (None, 0, text_of(dice, 60) + " bad.")]
    pages = spark.createDataFrame(rows, "batch_id string, page_no long, text string")
    config = ChunkConfig(strategy="semantic", size=100, overlap=10, min_size=20, max_size=300)
    plain = sorted(map(tuple, pipeline.chunk(pages, config, Picky()).collect()), key=repr)
    monkeypatch.setattr(pipeline, "LONG_PAGE", 700)
    monkeypatch.setattr(long_pages, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, pipeline.chunk(pages, config, Picky()).collect()), key=repr) == plain


def test_a_task_has_few_blocks_as_objects_at_once():
    rows = [{"page": i, "block": 0, "lengths": [5, 6], "cuts": [0]} for i in range(1000)]
    batch = pa.RecordBatch.from_pylist(rows)
    made = list(long_pages._functions(iter([batch]), 10))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) <= long_pages.BLOCKS_AT_ONCE
