import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.functions import text as T
from papyrion.operators import chat, vectors
from papyrion.operators.order import in_order, numbered
from papyrion.operators.sizing import add_overlap, bound_sizes
from papyrion.operators.split import HashEmbedder, semantic_chunks, semantic_pages
from papyrion.plans import pipeline
from papyrion.session import scratch, ship_package, stage
from papyrion.sources import cache, pages


def test_scan_files_goes_on_behind_a_bad_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("one\ftwo é".encode())
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"not asked for")

    def parse(content):
        if content == b"bad":
            raise ValueError("no pages")
        return pages.text_parser(content)

    got = [(r.batch_id.split("/")[-1], r.page_no, r.text, r.error) for r in pages.scan_files(spark, f"file://{tmp_path}", parse).collect()]
    assert sorted(got, key=repr) == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two é", None), ("b.pdf", None, None, "ValueError: no pages")]


class Picky(HashEmbedder):
    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return super().__call__(texts)


def test_a_failing_embedder_gives_fixed_chunks_for_the_whole_batch(spark):
    long = "One two three. Four five six! Seven? " * 10
    rows = [("a", 0, long), ("a", 1, "A bad page. " * 20), ("b", 0, long), (None, 0, long + "bad."), ("six", 0, long)] + [("six", i, "x") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "batch_id string, page_no long, text string")
    config = ChunkConfig(size=120, overlap=10, min_size=20, max_size=400)
    got = {}
    for r in pipeline.placed_chunks(df, config, Picky()).orderBy("place").collect():
        got.setdefault((r.batch_id, r.page_no), []).append(r.text)
    fixed, meant = ([t for _, t in f] for f in (pipeline_fixed(long, config), semantic_chunks(long, HashEmbedder(), config)))
    assert got["a", 0] == fixed and got["b", 0] == meant != fixed and got["six", 0] == fixed
    assert got[None, 0] == [t for _, t in pipeline_fixed(long + "bad.", config)]
    assert semantic_pages([long, "A bad page. So bad.", ""], Picky(), config) == [semantic_chunks(long, HashEmbedder(), config), None, [(0, "")]]


class Noting(Picky):
    """Writes down what it has embedded."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def __call__(self, texts):
        made = super().__call__(texts)
        with open(self.path, "a") as file:
            file.write("".join(f"{t}\n" for t in texts))
        return made


def test_other_pages_are_not_embedded_again_if_the_embedder_fails(spark, tmp_path):
    page = lambda name: f"{name} one. {name} two! {name} three? " * 8
    config = ChunkConfig(strategy="semantic", size=60, overlap=10, min_size=20, max_size=400)
    alone = [("a", 0, page("a")), ("b", 0, page("bad")), (None, 0, page("n")), ("d", 0, page("d")), ("d", 1, ""), ("e", 0, None)]
    # The second also has batches with pages of both kinds, and two pages with one number.
    for mixed in ([], [("c", 0, page("c")), ("c", 1, page("bad")), ("c", 1, page("x")), ("f", 0, page("f")), ("f", 7, page("bad"))]):
        log = tmp_path / f"log{len(mixed)}"
        df = spark.createDataFrame(alone + mixed, "batch_id string, page_no long, text string").repartition(3)
        got = pipeline.placed_chunks(df, config, Noting(log)).orderBy("place").collect()
        assert log.read_text().count("n two! n three? n one.") == 7
        assert [r.place for r in got] == list(range(len(got)))
        failed = {"b"} | {b for b, *_ in mixed}
        made = lambda b, t: pipeline_fixed(t or "", config) if b in failed else semantic_chunks(t or "", HashEmbedder(), config)
        want = [(b, n, i, *c) for b, n, t in sorted(alone + mixed, key=lambda r: (r[0] or "", r[1])) for i, c in enumerate(made(b, t))]
        found = [(r.batch_id, r.page_no, r.piece, r.start_index, r.text) for r in got]
        assert sorted(found, key=str) == sorted(want, key=str)
        # Each page's chunks follow each other, and the pages too.
        assert [r[:2] for r in found] == [r[:2] for r in want] and all(r[2] in (0, before[2] + 1) for before, r in zip(found, found[1:]))


def test_the_stand_in_counts_tokens(monkeypatch):
    from papyrion.operators import split

    texts = ["", "a b a", " \n", "c " * 50, "a", "\u3000é\xa0é"]
    want = [[sum(split._buckets(8)[t] == b for t in text.split()) for b in range(8)] for text in texts]
    for tokens in (1, 3, 1 << 13):
        monkeypatch.setattr(split, "COUNT_TOKENS", tokens)
        assert HashEmbedder(8)(texts).tolist() == want
    assert HashEmbedder(8)([]).shape == (0, 8)


def pipeline_fixed(text, config):
    from papyrion.operators.split import fixed_chunks

    return fixed_chunks(text, config.size, config.overlap)


def test_the_last_resort(spark):
    df = spark.createDataFrame([("a", 0, "x " * 900), (None, 0, "y")], "batch_id string, page_no long, text string")

    def broken(*_):
        return spark.range(3).select(F.raise_error(F.lit("late")).alias("x"))

    made, error = pipeline.chunk_or_plain(df, ChunkConfig(), None, broken)
    assert "late" in error and {r.batch_id for r in made.collect()} == {"a", None}
    rows = {r.batch_id: r for r in pipeline.report(df, made, ChunkConfig(), error=error, took_ms=70).collect()}
    assert rows[None].num_chunks == 1 and rows["a"].num_chunks == 2
    assert all(r.strategy == "emergency_fallback" and r.chunk_size is None and r.error == error for r in rows.values())
    made, error = pipeline.chunk_or_plain(df, ChunkConfig())
    assert error is None and made.count() == 3


def test_reports_of_hits_misses_and_a_null_batch(spark):
    df = spark.createDataFrame([("a", 0, "one"), (None, 0, "two"), ("c", 0, None)], "batch_id string, page_no long, text string")
    config = ChunkConfig()
    made = pipeline.chunk(df, config)
    cached = cache.batch_keys(df.where("batch_id = 'a'"), config)
    rows = {r.batch_id: r for r in pipeline.report(df, made, config, cached=cached, took_ms=1249).collect()}
    assert (rows["a"].strategy, rows["a"].took_ms, rows["a"].cache_hit, rows["a"].max_size) == ("cached", 100, True, None)
    assert (rows[None].strategy, rows[None].num_chunks, rows[None].cache_hit, rows[None].max_size) == ("fixed", 1, False, 1500)
    assert rows["c"].num_chunks == 0
    texts = {r.batch_id: r.text.split("\n") for r in pipeline.report_text(pipeline.report(df, made, config, cached=cached, took_ms=1249)).collect()}
    assert texts["a"][:4] == ["Strategy: cached", "Chunks: 1", "Time: 0.1s", "Cache: hit"] and len(texts["a"]) == 6
    assert texts[None][2] == "Time: 1.2s" and texts[None][-1] == "Overlap: 100"


def test_strict_keys_name_the_embedder(spark):
    key = lambda mode, config, embed=None: spark.range(1).select(cache.config_key(config, mode, embed)).first()[0]
    config = ChunkConfig()
    assert key("strict", config) != key("strict", config, HashEmbedder()) != key("strict", config, Picky())
    assert key("strict", ChunkConfig(embedder="m"), HashEmbedder()) == key("strict", ChunkConfig(embedder="m"), Picky())
    assert key("compat", config) == key("compat", config, HashEmbedder())


def test_cache_clear_and_directory(spark, tmp_path):
    held = cache.ChunkCache(spark, f"file://{tmp_path}/cache")
    assert held.info().first()[:] == (0, 0.0, held.path)
    held.append(spark.createDataFrame([("c", "f", "é" * 600_000)], "content_fp string, config_fp string, text string"))
    assert held.info().first()[:] == (1, round(1_200_000 / 1048576, 6), held.path)
    held.clear()
    assert held.info().first().cache_files == 0 and not held.exists()


@pytest.mark.parametrize("n, small, split", [(199, True, False), (200, False, False), (1500, False, False), (1501, False, True)])
def test_bounds_are_inclusive(spark, n, small, split):
    rows = [("a", 0, "x" * 300), ("a", 1, ("y " * 1000)[: n - 1] + "y")]
    df = numbered(in_order(spark.createDataFrame(rows, "batch_id string, page_no long, text string").withColumn("start_index", F.lit(0)), F.col("batch_id"), F.col("page_no")))
    got = bound_sizes(df, ChunkConfig()).orderBy("place", "sub").collect()
    assert len(got) == (1 if small else 3 if split else 2)


@pytest.mark.parametrize("last, merged", [(1300, True), (1301, False)])
def test_a_merge_may_reach_the_upper_bound_and_not_exceed_it(spark, last, merged):
    rows = [("a", 0, "x" * last), ("a", 1, "y" * 199)]
    df = numbered(in_order(spark.createDataFrame(rows, "batch_id string, page_no long, text string").withColumn("start_index", F.lit(0)), F.col("batch_id"), F.col("page_no")))
    assert max(r.n for r in bound_sizes(df, ChunkConfig()).select(F.length("text").alias("n")).collect()) == (1500 if merged else 1301)


def test_overlap_longer_than_a_chunk_takes_it_whole(spark):
    rows = [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three")]
    df = numbered(in_order(spark.createDataFrame(rows, "batch_id string, page_no long, text string").withColumn("start_index", F.lit(0)), F.col("batch_id"), F.col("page_no")))
    assert [r.text for r in add_overlap(df, ChunkConfig(overlap=4)).orderBy("place").collect()] == ["one\ntwo", "one\ntwo\nthre", "two\nthree"]


def test_labels(spark):
    df = spark.createDataFrame([(0, 0), (1048576, 1000), (52428, 49), (52429, 50), (157286399, 949), (None, None)], "b long, ms long")
    got = [tuple(r) for r in df.select(T.size_label(F.col("b")), T.time_label(F.col("ms"))).collect()]
    assert got == [("0.0 MB", "0.0s"), ("1.0 MB", "1.0s"), ("0.0 MB", "0.0s"), ("0.1 MB", "0.1s"), ("150.0 MB", "0.9s"), (None, None)]


def test_nearest_with_unequal_norms_ties_and_nulls(spark):
    rows = [(1, [2.0, 0.0]), (2, [10.0, 0.1]), (3, [0.0, 1.0]), (5, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 0.0]), (6, None), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id = 3").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    for metric, want in (("l2", [1, 4, 5, 7, 3]), ("cosine", [1, 2, 4, 5, 3])):
        one = [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 5, metric=metric).collect()]
        many = vectors.top_k_batch(df, asked, vectors.RetrievalConfig(metric=metric)).orderBy("rank").collect()
        assert one == want and [r.vec_id for r in many] == want
    assert vectors.top_k(df.limit(0), [1.0, 0.0]).count() == 0


class Session:
    """What the log means, event by event."""

    def __init__(self):
        self.history, self.now, self.messages = [], None, 0
        self.saved_at = {}

    def on(self, kind, conv, seq=0):
        if kind == "message":
            self.messages += 1
        elif kind == "save" or kind in ("new", "ingest") and conv is not None:
            if conv not in self.history:
                self.history.append(conv)
            self.now, self.saved_at[conv] = conv, seq
        elif kind == "load" and conv in self.history:
            if self.now is not None:  # what is current is saved before another is shown
                self.saved_at[self.now] = seq
            self.now = conv
        elif kind == "delete" and conv in self.history:
            self.history.remove(conv)
            self.now = None if self.now == conv else self.now
        elif kind == "clear":
            self.history, self.now = [], None
        if kind in ("new", "ingest", "discard"):
            self.now = None


def test_sessions_against_event_by_event(spark):
    dice = random.Random(6)
    kinds = ["message", "save", "save", "load", "new", "ingest", "discard", "delete", "clear", "error"]
    rows = []
    for session in (*range(12), None):
        for seq in range(40):
            kind = dice.choices(kinds, [3, 4, 4, 3, 1, 1, 1, 2, 0.4, 1])[0]
            conv = dice.randrange(5) if kind in ("save", "load", "delete") or kind in ("new", "ingest") and dice.random() < 0.5 else None
            rows.append((session, seq, kind, conv))
    log = spark.createDataFrame(rows, "session_id long, seq long, kind string, conv_id long")
    want = {}
    for session, seq, kind, conv in rows:
        want.setdefault(session, Session()).on(kind, conv, seq)
    last = {(r.session_id, r.conv_id): r.last_seq for r in chat.history(log).collect()}
    assert last == {(k, c): s.saved_at[c] for k, s in want.items() for c in s.history}
    saved = {}
    for r in chat.positions(chat.history(log)).orderBy("position").collect():
        saved.setdefault(r.session_id, []).append(r.conv_id)
    assert saved == {k: s.history for k, s in want.items() if s.history}
    assert {r.session_id: (r.n_messages, r.n_saved, r.conv_id) for r in chat.state(log).collect()} == {k: (s.messages, len(s.history), s.now) for k, s in want.items()}
    shown = {}
    for r in chat.recent(chat.history(log), 3, chat.current(log)).orderBy("shown").collect():
        shown.setdefault(r.session_id, []).append((r.conv_id, r.is_current))
    assert shown == {k: [(c, c == s.now) for c in s.history[-3:]] for k, s in want.items() if s.history}


def test_saved_conversations_keep_messages_in_order(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a" * 31), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    log = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-02 03:04:05', 7L, 0L, 'save', 1L), (timestamp'2024-05-06 07:08:09', 7L, 1L, 'save', 1L), (timestamp'2024-05-06', CAST(NULL AS BIGINT), 2L, 'new', 2L), (timestamp'2024-05-06', 7L, 3L, 'save', 9L) AS t(ts, session_id, seq, kind, conv_id)")
    got = {(r.session_id, r.conv_id): (r.title, [tuple(m) for m in r.messages], str(r.saved_at)[:10]) for r in chat.saved_conversations(turns, log).collect()}
    assert got == {(7, 1): ("a" * 30 + "...", [("user", "a" * 31), ("assistant", "b")], "2024-05-06"), (None, 2): (None, [("user", None)], "2024-05-06")}


def test_a_batch_of_vectors_is_embedded_in_one_call():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return np.ones((len(texts), 2))

    made = semantic_pages(["One. Two. Three.", "", "Alone.", "Four! Five?"], embed, ChunkConfig(min_size=0))
    assert calls == [5] and [len(m) for m in made] == [1, 1, 1, 1]


def test_scratch_deletes_what_was_staged_on_the_way(spark):
    with scratch(spark) as keep:
        inner = stage(spark.range(3), "inner")
        with scratch(spark) as keep_inner:
            middle = keep_inner(inner, "middle")
        kept = keep(middle, "kept")
    assert kept.count() == 3 and stage(spark.range(2), "later").count() == 2
    for gone in (inner, middle):
        with pytest.raises(Exception, match="(?i)not exist|no such|found"):
            gone.count()


def test_the_package_can_be_shipped(spark):
    ship_package(spark)
    assert spark.range(1).mapInArrow(lambda batches: batches, "id long").count() == 1


@pytest.mark.parametrize("name, executed", [("hybrid", "semantic"), ("semantic", "semantic"), ("fixed", "fixed"), ("something else", "fixed"), (None, "fixed")])
def test_a_configuration_by_name(name, executed):
    from papyrion.config import chunk_config
    from papyrion.operators.split import executed as executed_of

    config = chunk_config(name, size=300, overlap=20)
    assert (config.strategy, config.size, config.overlap, config.min_size) == (name, 300, 20, 200)
    if name != "hybrid":  # hybrid goes by pages
        assert executed_of(config.strategy, HashEmbedder()) == executed
    with pytest.raises(ValueError):
        chunk_config(name, size=10, overlap=10)


def test_a_load_of_a_conversation_that_is_not_there_gives_nothing(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "ho"), (None, 0, "user", "no name")], "conv_id long, turn long, role string, text string")
    wanted = spark.createDataFrame([(2,), (7,), (-1,), (2,)], "conv_id long")
    assert [r.content for r in chat.load(turns, wanted).collect()] == ["ho"]
    assert chat.load(turns, wanted.limit(0)).count() == 0


class LazyModel:
    """Makes its model at the first call in a worker, and counts how often."""

    made = 0

    def __call__(self, prompts):
        if "model" not in self.__dict__:
            LazyModel.made += 1
            self.model = LazyModel.made
        return [f"{self.model}" for _ in prompts]


def test_a_generator_is_made_once_in_a_worker(spark):
    prompts = spark.range(500).selectExpr("cast(id as string) prompt").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert {r.reply for r in pipeline.generate_texts(prompts, LazyModel()).collect()} == {"1"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_entry_without_chunks_is_a_miss(spark, tmp_path):
    held = cache.ChunkCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([("a", 0, "text"), ("b", 0, ""), ("c", 0, None)], "batch_id string, page_no long, text string")
    config = ChunkConfig(strategy="fixed")
    assert {r.batch_id for r in pipeline.cached_chunks(rows, held, config).collect()} == {"a"}
    assert {r.batch_id for r in held.misses(cache.batch_keys(rows, config)).collect()} == {"b", "c"}


def test_uploads_are_files_of_bounded_length(spark, tmp_path, monkeypatch):
    from papyrion.plans import catalog

    monkeypatch.setattr(catalog, "UPLOAD_PAGES", 7, raising=False)
    rows = [(i, f"text {i}", "a" if i % 3 else "b") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = pages.scan_files(spark, catalog._uploads(spark, str(tmp_path)), pages.text_parser, "*.txt").where("text <> ''")
    assert sorted(r.text for r in found.collect()) == sorted(text for _, text, _ in rows)
    assert max(r["count"] for r in found.groupBy("batch_id").count().collect()) <= 7


def test_pages_of_a_long_file_leave_in_parts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\f".join(map(str, range(1000))))
    found = pages.scan_files(spark, f"file://{tmp_path}", pages.text_parser, "*.txt")
    assert [r.text for r in found.orderBy("page_no").collect()] == [str(i) for i in range(1000)]
