import random

import pytest
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.functions import text as T
from papyrion.operators.order import in_order, numbered
from papyrion.operators.sizing import add_overlap, bound_sizes
from papyrion.operators.split import HashEmbedder, fixed_chunks, route, semantic_chunks
from papyrion.plans import pipeline
from papyrion.sources.cache import ChunkCache
from papyrion.streaming.ingest import ingest, watch_pages


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The contract, piece by piece, with lists of strings."""
    rest = list(separators)
    while rest[0] and rest[0] not in text:
        rest.pop(0)
    sep, rest = rest[0], rest[1:]
    parts = text.split(sep) if sep else list(text)
    pieces = [p if i == 0 or not sep else sep + p for i, p in enumerate(parts)]
    out, run = [], []

    def flush():
        held = []
        for piece in run:
            if sum(map(len, held)) + len(piece) > size:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                    held.pop(0)
            held.append(piece)
        if held:
            out.append("".join(held))
        run.clear()

    for piece in filter(None, pieces):
        if len(piece) < size:
            run.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, size, overlap, rest))
    flush()
    return [c.strip() for c in out if c.strip()]


def test_fixed_chunks_follow_the_contract():
    dice = random.Random(1)
    for _ in range(1500):
        text = "".join(dice.choice("aé😀  \n") * dice.choice((1, 1, 2, 9)) for _ in range(dice.randrange(60)))
        size = dice.choice((5, 8, 13, 30))
        overlap = dice.randrange(5)
        found = fixed_chunks(text, size, overlap)
        assert [c for _, c in found] == plain_split(text, size, overlap), (text, size, overlap)
        assert all(text[s : s + len(c)] == c and len(c) <= size for s, c in found)


def test_semantic_chunks_absorb_short_groups():
    config = ChunkConfig(strategy="semantic", min_size=12, threshold=50)
    text = "One two. One two. Red sky at night. Red sky at dawn! Zebra? Zebra."
    found = semantic_chunks(text, HashEmbedder(), config)
    assert " ".join(c for _, c in found) == text
    assert all(len(c) >= 12 for _, c in found[:-1])
    assert semantic_chunks("", HashEmbedder(), config) == [(0, "")]


@pytest.mark.parametrize("text", ["a\r\nb", "a\rb", "　a\n\n\n b\t", "\x1ca\n\x85b\xa0"])
def test_fingerprint_ignores_line_ends_and_outer_space(spark, text):
    row = spark.createDataFrame([(text, "a\nb")], "x string, y string").select(T.content_fingerprint(F.col("x")), T.content_fingerprint(F.col("y"))).first()
    assert row[0] == row[1]


def test_titles_answers_and_rounding(spark):
    df = spark.createDataFrame([("x" * 30, "y" * 31, "a Answer: b Answer: c\n", " none ")], "a string, b string, c string, d string")
    row = df.select(T.title(F.col("a")), T.title(F.col("b")), T.extract_answer(F.col("c")), T.extract_answer(F.col("d"))).first()
    assert tuple(row) == ("x" * 30, "y" * 30 + "...", "c", "none")
    key = lambda n: spark.range(1).select(T.config_fingerprint(F.lit("fixed"), F.lit(n), F.lit(100), F.lit(85))).first()[0]
    assert key(950) == key(1000) == key(1049) == key(1050) != key(1051)


def _placed(spark, rows):
    df = spark.createDataFrame([(b, i, t, 0) for i, (b, t) in enumerate(rows)], "batch_id string, page_no long, text string, start_index int")
    return numbered(in_order(df, F.col("batch_id").asc_nulls_first(), F.col("page_no")))


def test_overlap_ends_of_batches_and_zero(spark):
    rows = [("a", "one"), ("a", "two"), ("b", "alone"), (None, "n1"), (None, "n2")]
    by = lambda config: {(r.batch_id, r.page_no): (r.text, r.chunk_index, r.total_chunks) for r in add_overlap(_placed(spark, rows), config).collect()}
    got = by(ChunkConfig(overlap=2))
    assert got == {("a", 0): ("one\ntw", 0, 2), ("a", 1): ("ne\ntwo", 1, 2), ("b", 2): ("alone", None, None), (None, 3): ("n1\nn2", 0, 2), (None, 4): ("n1\nn2", 1, 2)}
    assert by(ChunkConfig(overlap=0))["a", 0][0] == "one\n" and by(ChunkConfig(overlap=0))["a", 1][0] == "one\ntwo"
    assert by(ChunkConfig(overlap=0, overlap_zero="off"))["a", 0][0] == "one"


def fold(texts, config):
    out = []
    for t in texts:
        if len(t) < config.min_size and out and len(out[-1]) + 1 + len(t) <= config.max_size:
            out[-1] += "\n" + t
        elif len(t) > config.max_size:
            out += plain_split(t, config.size, config.overlap)
        else:
            out.append(t)
    return out


def test_bounds_against_a_plain_fold(spark):
    dice = random.Random(2)
    config = ChunkConfig(size=20, overlap=3, min_size=8, max_size=30)
    rows = [(dice.choice(("a", "a", "a", "b", None)), "w " * dice.choice((1, 2, 3, 4, 14, 15, 16, 40)) + "end") for _ in range(300)]
    got = bound_sizes(_placed(spark, rows), config).orderBy("place", "sub").collect()
    for batch in ("a", "b", None):
        assert [r.text for r in got if r.batch_id == batch] == fold([t for b, t in rows if b == batch], config)


def test_route_by_pages(spark):
    pages = spark.createDataFrame([(b, i, "t") for b, n in (("five", 5), ("six", 6)) for i in range(n)], "batch_id string, page_no int, text string")
    got = {(r.batch_id, r.strategy_executed) for r in route(pages, ChunkConfig(), HashEmbedder()).collect()}
    assert got == {("five", "semantic"), ("six", "fixed")}
    r = route(pages, ChunkConfig(strategy="semantic")).first()
    assert (r.strategy_executed, r.strategy_reported) == ("fixed", "semantic")


def test_cache_is_warm_the_second_time_and_stream_replays(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "x " * 900), ("copy", 0, "x " * 900), ("b", 0, "y"), ("e", 0, None)], "batch_id string, page_no long, text string")
    cache = ChunkCache(spark, f"file://{tmp_path}/cache")
    assert cache.info().first().cache_files == 0
    cold = sorted(map(tuple, pipeline.cached_chunks(pages, cache).collect()), key=repr)
    size = cache.read().count()
    warm = sorted(map(tuple, pipeline.cached_chunks(pages, cache).collect()), key=repr)
    assert cold == warm and cache.read().count() == size
    assert {r[0] for r in cold} == {"a", "copy", "b"}
    pages.coalesce(1).write.parquet(f"{tmp_path}/in/first.parquet")
    other = ChunkCache(spark, f"file://{tmp_path}/streamed")
    for k in range(2):
        ingest(watch_pages(spark, f"{tmp_path}/in/*"), other, f"{tmp_path}/check{k}", once=True).awaitTermination(120)
        assert other.read().count() == size


def test_empty_table(spark):
    pages = spark.createDataFrame([], "batch_id string, page_no long, text string")
    assert pipeline.chunk(pages).count() == 0


def test_answers_use_the_nearest_passages(spark):
    passages = spark.createDataFrame([(1, "red sky"), (2, "blue sea"), (3, None)], "vec_id long, text string")
    questions = spark.createDataFrame([(7, "blue sea?"), (8, "red sky")], "query_id long, question string")
    got = {r.query_id: r for r in pipeline.answer(questions, passages, HashEmbedder(), lambda prompts: [p + " Blue." for p in prompts]).collect()}
    assert got[8].context.startswith("red sky\n\n") and got[8].answer == "Blue."
