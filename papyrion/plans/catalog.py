"""The queries of the library by name, each over its whole tables, and DuckDB SQL for them (`oracles`)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.config import STRATEGIES, ChunkConfig
from papyrion.functions import text as T
from papyrion.operators import chat, long_pages, lsa, sizing, split, vector_index, vectors
from papyrion.operators.order import in_order, numbered
from papyrion.plans import measure, oracles, pipeline
from papyrion.session import stage, staging_path
from papyrion.sources import cache, page_source, pages, table_functions
from papyrion.sources.tables import table

FIXED = ChunkConfig(strategy="fixed")
SEMANTIC = ChunkConfig(strategy="semantic")
HYBRID = ChunkConfig(strategy="hybrid")
NO_OVERLAP = ChunkConfig(strategy="fixed", overlap=0)

QUERIES = {}
ORACLES = oracles.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.document_pages(_docs(spark, sf_dir), "source")


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.document_pages(_docs(spark, sf_dir))


def _placed(rows: DataFrame) -> DataFrame:
    """Whole pages taken for chunks, in order."""
    ordered = in_order(rows, F.col("batch_id").asc_nulls_first(), F.col("page_no").asc_nulls_first())
    return numbered(ordered.withColumns({"start_index": F.lit(0)}), name="pages")


@query
def scan_pages(spark, sf_dir):
    return _by_source(spark, sf_dir).select("batch_id", "page_no", F.length("text").cast("long").alias("n_chars"))


#: Pages of one uploaded file, at most.
UPLOAD_PAGES = 1000


def _uploads(spark: SparkSession, sf_dir: str) -> str:
    """A folder with files of pages, divided by form feeds, as they would be uploaded."""
    path = staging_path(spark, "uploads")
    texts = _docs(spark, sf_dir).where("text <> ''").select("source", "text")
    # A parser gets a file whole, so an upload has a bounded number of pages: a source with more has more files.
    texts.write.partitionBy("source").option("maxRecordsPerFile", UPLOAD_PAGES).option("lineSep", "\f").text(path)
    return path


def _uploaded(found: DataFrame) -> DataFrame:
    # A file ends with a form feed, behind which there is an empty page; a file that cannot be parsed shows by its error.
    source = F.regexp_extract("batch_id", "source=([^/]*)/", 1)
    return found.where("text <> '' OR error IS NOT NULL").select(source.alias("source"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "error")


@query
def scan_uploads(spark, sf_dir):
    """Uploaded files, one by one parsed into pages."""
    return _uploaded(pages.scan_files(spark, _uploads(spark, sf_dir), pages.text_parser, "*.txt"))


@query
def scan_uploads_sql(spark, sf_dir):
    """The same pages by a data source in SQL."""
    page_source.register(spark)
    # A view of its own name for each call: its rows are read only later.
    view = f"uploads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY VIEW {view} USING page_files OPTIONS (path '{_uploads(spark, sf_dir)}', glob '*.txt')")
    found = spark.sql(f"SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return _uploaded(found)


@query
def batch_text(spark, sf_dir):
    return pages.batch_text(pages.line_pages(_docs(spark, sf_dir)))


@query
def content_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_fingerprint(F.col("text")).alias("content_fp"))


@query
def config_fingerprint(spark, sf_dir):
    """Settings that the numbers of each line item stand for, over the whole reach of the sliders."""
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    size, overlap, threshold = 500 + F.col("l_partkey") % 1501, F.col("l_suppkey") % 301, 50 + F.col("l_orderkey") % 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.config_fingerprint(strategy, size, overlap, threshold).alias("config_fp"))


@query
def chunk_sizes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def fixed_chunks(spark, sf_dir):
    made = split.split_pages(_doc_pages(spark, sf_dir), FIXED)
    return made.select(F.col("batch_id").alias("doc_id"), F.col("piece").cast("long").alias("piece"), F.col("start_index").cast("long").alias("start_index"), "text")


@query
def fixed_chunks_sql(spark, sf_dir):
    """The same chunks by a table function in SQL."""
    table_functions.register(spark)
    pages_ = _doc_pages(spark, sf_dir).withColumn("batch_id", F.col("batch_id").cast("string"))
    return spark.sql("SELECT CAST(batch_id AS BIGINT) AS doc_id, CAST(piece AS BIGINT) AS piece, CAST(start_index AS BIGINT) AS start_index, text FROM fixed_chunks(TABLE(SELECT * FROM {pages}), 1000, 100)", pages=pages_)


@query
def semantic_chunks(spark, sf_dir):
    made = split.split_pages(_doc_pages(spark, sf_dir), SEMANTIC, split.HashEmbedder())
    return made.select(F.col("batch_id").alias("doc_id"), F.col("piece").cast("long").alias("piece"), F.col("start_index").cast("long").alias("start_index"), "text")


@query
def semantic_chunks_by_sentence(spark, sf_dir):
    """The same chunks, made from sentences as rows, as a page too long for one task would be."""
    made = long_pages.semantic_chunks_of(_doc_pages(spark, sf_dir), SEMANTIC, split.HashEmbedder())
    return made.select(F.col("batch_id").alias("doc_id"), F.col("piece").cast("long").alias("piece"), F.col("start_index").cast("long").alias("start_index"), "text")


class FailingEmbedder(split.HashEmbedder):
    """Fails on texts with a letter that it does not know."""

    def __call__(self, texts):
        if any("ß" in t for t in texts):
            raise ValueError("unknown letter")
        return super().__call__(texts)


@query
def semantic_fallback(spark, sf_dir):
    """Chunks by meaning, and fixed ones of the batches that the embedder fails on."""
    made = pipeline.placed_chunks(_doc_pages(spark, sf_dir), SEMANTIC, FailingEmbedder())
    return made.select(F.col("batch_id").alias("doc_id"), F.col("piece").cast("long").alias("piece"), F.col("start_index").cast("long").alias("start_index"), "text")


def _broken(*_):
    raise RuntimeError("no chunks today")


@query
def emergency_chunks(spark, sf_dir):
    """What is left when the chunker fails as a whole."""
    made, error = pipeline.chunk_or_plain(_doc_pages(spark, sf_dir), HYBRID, split.HashEmbedder(), _broken)
    return made.select(F.col("batch_id").alias("doc_id"), F.col("piece").cast("long").alias("piece"), "text", F.lit(error).alias("error"))


@query
def hybrid_route(spark, sf_dir):
    routed = split.route(pages.line_pages(_docs(spark, sf_dir)), HYBRID, split.HashEmbedder())
    by_batch = routed.groupBy(F.col("batch_id").alias("doc_id"), "strategy_requested", "strategy_executed", "strategy_reported")
    return by_batch.agg(F.count("*").alias("n_pages"))


def _overlapped(spark, sf_dir, config):
    made = sizing.add_overlap(_placed(_by_source(spark, sf_dir)), config)
    return made.select("batch_id", "page_no", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "text")


@query
def overlap_context(spark, sf_dir):
    return _overlapped(spark, sf_dir, FIXED)


@query
def overlap_zero_compat(spark, sf_dir):
    return _overlapped(spark, sf_dir, NO_OVERLAP)


def _bounded(placed, config):
    made = sizing.bound_sizes(placed, config)
    return made.select("batch_id", "page_no", F.col("sub").cast("long").alias("sub"), "text")


@query
def size_merge(spark, sf_dir):
    """Lines of each document as chunks, none so long that it is split."""
    lines = pages.line_pages(_docs(spark, sf_dir)).withColumn("page_no", F.col("page_no").cast("long"))
    return _bounded(_placed(lines), ChunkConfig(strategy="fixed", max_size=100_000))


@query
def size_filter_full(spark, sf_dir):
    return _bounded(_placed(_by_source(spark, sf_dir)), FIXED)


def _chunked(rows, config, embed=None):
    made = pipeline.chunk(rows, config, embed)
    return made.select("batch_id", "ord", F.col("sub").cast("long").alias("sub"), "text")


@query
def chunk_pipeline(spark, sf_dir):
    return _chunked(_by_source(spark, sf_dir), HYBRID, split.HashEmbedder())


def _doc_chunks(spark, sf_dir):
    return pipeline.chunk(_doc_pages(spark, sf_dir), FIXED)


@query
def chunk_stats(spark, sf_dir):
    n = F.length("text")
    return _doc_chunks(spark, sf_dir).groupBy(F.col("batch_id").alias("doc_id")).agg(
        F.count("*").alias("n_chunks"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.sum(n).alias("total")
    )


@query
def empty_batches(spark, sf_dir):
    """Batches that a cache of all chunks misses, since they have none: every tenth document without its text, and those that have none."""
    docs = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 10 > 0, F.col("text")))
    rows = pages.document_pages(docs)
    held = cache.ChunkCache(spark, staging_path(spark, "cache"))
    # Written, since keys are read several times, and each time would take all texts.
    keys = stage(cache.batch_keys(rows, FIXED, "compat"), "batch-keys")
    pipeline.cached_chunks(rows, held, FIXED, mode="compat", keys=keys)
    return held.misses(keys).select(F.col("batch_id").alias("doc_id"), "content_fp")


@query
def run_report(spark, sf_dir):
    return pipeline.report(_doc_pages(spark, sf_dir), _doc_chunks(spark, sf_dir), FIXED, mode="compat", took_ms=1250)


@query
def run_report_cached(spark, sf_dir):
    """If the documents in English are in the cache: what hits are said to be, and misses."""
    return pipeline.report(_doc_pages(spark, sf_dir), _doc_chunks(spark, sf_dir), FIXED, mode="compat", cached=_keys(spark, sf_dir, "en"), took_ms=1250)


@query
def run_report_emergency(spark, sf_dir):
    rows = _doc_pages(spark, sf_dir)
    made, error = pipeline.chunk_or_plain(rows, FIXED, None, _broken)
    return pipeline.report(rows, made, FIXED, mode="compat", took_ms=1250, error=error)


@query
def run_measured(spark, sf_dir):
    """Numbers of a run over all documents, counted as its chunks are written."""
    _, seen = measure.run(_doc_pages(spark, sf_dir), FIXED)
    row = (seen.n_chunks, seen.n_chars, seen.least, seen.most, seen.n_enhanced, seen.took_ms > 0)
    return spark.createDataFrame([row], "n_chunks long, n_chars long, least long, most long, n_enhanced long, took_time boolean")


@query
def run_report_text(spark, sf_dir):
    return pipeline.report_text(run_report(spark, sf_dir))


def _keys(spark, sf_dir, lang=None):
    docs = _docs(spark, sf_dir)
    return cache.batch_keys(pages.document_pages(docs if lang is None else docs.where(F.col("lang") == lang)), FIXED, "compat")


@query
def cache_key(spark, sf_dir):
    return _keys(spark, sf_dir).withColumnRenamed("batch_id", "doc_id")


@query
def cache_hits(spark, sf_dir):
    """Documents that are cached if those in English are; copies in other batches hit too."""
    return cache.hits(_keys(spark, sf_dir), _keys(spark, sf_dir, "en")).select(F.col("batch_id").alias("doc_id"), "content_fp")


@query
def cache_misses(spark, sf_dir):
    return cache.misses(_keys(spark, sf_dir), _keys(spark, sf_dir, "en")).select(F.col("batch_id").alias("doc_id"), "content_fp")


@query
def cache_info(spark, sf_dir):
    """Of a cache that holds each document's text whole."""
    texts = _docs(spark, sf_dir).select("doc_id", "text", T.content_fingerprint(F.col("text")).alias("content_fp"), cache.config_key(FIXED, "compat").alias("config_fp"))
    return cache.info(texts.groupBy(*cache.KEY).agg(F.min_by("text", "doc_id").alias("text")))


@query
def cache_clear(spark, sf_dir):
    """What a cache on disk holds after an append, after the same append again, and after it is cleared."""
    held = cache.ChunkCache(spark, staging_path(spark, "cache"))
    texts = _docs(spark, sf_dir).select("doc_id", "text", T.content_fingerprint(F.col("text")).alias("content_fp"), cache.config_key(FIXED, "compat").alias("config_fp"))
    entries = texts.groupBy(*cache.KEY).agg(F.min_by("text", "doc_id").alias("text"))
    states = []
    for step, act in enumerate((lambda: None, lambda: held.append(entries), lambda: held.append(entries), held.clear)):
        act()
        # Written, since the next step changes what the table holds.
        states.append(stage(held.info().select(F.lit(step).cast("long").alias("step"), "cache_files", "total_size_mb", F.endswith("cache_dir", F.lit(held.path)).alias("same_dir")), "cache-state"))
    return reduce(DataFrame.unionByName, states)


@query
def cache_evicted(spark, sf_dir):
    """What is taken out of a cache that got the documents language by language, and saw every tenth one used since.

    First what has been idle for too long goes, then, from what was used longest ago, what is above a megabyte of text.
    """
    held = cache.ChunkCache(spark, staging_path(spark, "cache"))
    texts = _docs(spark, sf_dir).select("doc_id", "lang", "text", T.content_fingerprint(F.col("text")).alias("content_fp"), cache.config_key(FIXED, "compat").alias("config_fp"))
    for i, lang in enumerate(("de", "en", "es", "fr"), 1):
        held.append(texts.where(F.col("lang") == lang).groupBy(*cache.KEY).agg(F.min_by("text", "doc_id").alias("text")), now=1000 * i)
    held.touch(texts.where(F.col("doc_id") % 10 == 0), now=5000)
    gone = held.evict(max_age=3500, max_bytes=1_000_000, now=6000)
    return gone.select("content_fp", "bytes", F.unix_seconds("last_used").alias("last_used"), "reason")


@query
def size_labels(spark, sf_dir):
    n = F.octet_length("text")
    return _docs(spark, sf_dir).select("doc_id", T.size_label(n * 37).alias("size"), T.time_label(n).alias("time"))


@query
def hash_embed(spark, sf_dir):
    return vectors.bucket_counts(_docs(spark, sf_dir), "doc_id", "text").withColumn("bucket", F.col("bucket").cast("long"))


@query
def embed_chunks(spark, sf_dir):
    made = vectors.embed_texts(split.split_pages(_doc_pages(spark, sf_dir), FIXED), split.HashEmbedder())
    total = lambda f: F.aggregate("embedding", F.lit(0.0), lambda s, x: s + f(x)).cast("long")
    return made.select(
        F.col("batch_id").alias("doc_id"), F.col("start_index").cast("long").alias("start_index"), total(lambda x: x).alias("n_tokens"), total(lambda x: x * x).alias("norm_sq")
    )


@query
def vector_topk(spark, sf_dir):
    """The nearest to the vector with the least id."""
    found = table(spark, sf_dir, "embeddings")
    asked = found.where("embedding IS NOT NULL").orderBy("vec_id").limit(1).first()
    return vectors.top_k(found, asked["embedding"] if asked else []).select("vec_id", F.round("distance", 6).alias("distance"))


def _asked(found):
    return found.where(F.col("vec_id") % 100 == 0)


@query
def vector_topk_batch(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings")
    near = vectors.top_k_batch(found, _asked(found))
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@query
def vector_topk_ann(spark, sf_dir):
    """The same by way of an index, which reads as many cells as give a recall of 0.95 on a sample."""
    found = table(spark, sf_dir, "embeddings")
    near = vector_index.search(vector_index.build_index(found), _asked(found))
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@query
def vector_topk_indexed(spark, sf_dir):
    """The same by way of an index, which also reads all cells that may hold a nearer vector."""
    found = table(spark, sf_dir, "embeddings")
    near = vector_index.search(vector_index.build_index(found), _asked(found), exact=True)
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@query
def vector_topk_in_batch(spark, sf_dir):
    """The nearest among the vectors with the query's own label."""
    found = table(spark, sf_dir, "embeddings")
    near = vectors.top_k_in_batches(found, _asked(found), batch="label")
    return near.select(F.col("label").cast("long").alias("label"), "query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@query
def nearest_documents(spark, sf_dir):
    """The documents nearest to every hundredth one, by vectors on axes that are fitted on all documents."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    found = stage(vectors.embed_texts(docs, lsa.fit_embedder(docs)).drop("text"), "document-vectors")
    near = vectors.top_k_batch(found, _asked(found))
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


def _retrieved(spark, sf_dir):
    """Neighbours among the vectors that have a document, and the documents."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    found = table(spark, sf_dir, "embeddings").join(docs.select("vec_id"), "vec_id", "left_semi")
    return vectors.top_k_batch(found, _asked(found)), docs


@query
def retrieve_context(spark, sf_dir):
    ranked, docs = _retrieved(spark, sf_dir)
    return ranked.join(docs, "vec_id").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "text")


@query
def build_context(spark, sf_dir):
    return pipeline.contexts(*_retrieved(spark, sf_dir))


@query
def build_prompt(spark, sf_dir):
    ranked, docs = _retrieved(spark, sf_dir)
    asked = docs.select(F.col("vec_id").alias("query_id"), T.title(F.col("text")).alias("question"))
    return pipeline.contexts(ranked, docs).join(asked, "query_id").select("query_id", T.build_prompt(F.col("context"), F.col("question")).alias("prompt"))


def _said_length(prompts):
    """Stands in for a model: its reply goes on behind the prompt."""
    return [f"{p} {len(p)} characters. " for p in prompts]


@query
def answers(spark, sf_dir):
    """Questions made of every hundredth document, answered from the documents nearest to them."""
    docs = _docs(spark, sf_dir)
    questions = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), T.title(F.col("text")).alias("question"))
    passages = docs.select(F.col("doc_id").alias("vec_id"), "text")
    return pipeline.answer(questions, passages, split.HashEmbedder(), _said_length)


@query
def answers_in_batch(spark, sf_dir):
    """The same questions, each answered from the documents of its own document's source."""
    docs = _docs(spark, sf_dir)
    questions = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), T.title(F.col("text")).alias("question"), "source")
    passages = docs.select(F.col("doc_id").alias("vec_id"), "text", "source")
    return pipeline.answer(questions, passages, split.HashEmbedder(), _said_length, scope="source")


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query
def extract_answer(spark, sf_dir):
    marked = F.when(F.col("role") == "assistant", F.concat(F.lit("Answer: no. Answer: \n"), "text", F.lit(" \n"))).otherwise(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.extract_answer(marked).alias("answer"))


@query
def conversation_messages(spark, sf_dir):
    return chat.messages(_turns(spark, sf_dir))


@query
def chat_titles(spark, sf_dir):
    return chat.titles(_turns(spark, sf_dir))


@query
def conversation_snapshot(spark, sf_dir):
    return chat.snapshots(_turns(spark, sf_dir))


@query
def load_conversation(spark, sf_dir):
    """The conversations that some session has in its history."""
    return chat.load(_turns(spark, sf_dir), chat.history(_log(spark, sf_dir), by_loads=False))


# What each kind of event stands for in the log; the conversation is the number in its properties.
KINDS = {"click": "message", "purchase": "save", "view": "load", "signup": "delete", "error": "error"}
CLEARING = KINDS | {"signup": "clear"}
RESETTING = {"click": "message", "purchase": "save", "view": "ingest", "signup": "discard", "error": "new"}


def _log(spark, sf_dir, kinds=KINDS):
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        "ts", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("conv_id")
    )


@query
def conversation_state(spark, sf_dir):
    return chat.state(_log(spark, sf_dir, CLEARING))


@query
def session_resets(spark, sf_dir):
    """The state of sessions that begin new chats, load new files and discard chats."""
    return chat.state(_log(spark, sf_dir, RESETTING))


@query
def saved_conversations(spark, sf_dir):
    """The history as it is kept, with the messages of each conversation as lines."""
    made = chat.saved_conversations(_turns(spark, sf_dir), _log(spark, sf_dir, RESETTING))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return made.select("session_id", "conv_id", T.saved_label(F.col("saved_at")).alias("saved_at"), "title", F.size("messages").cast("long").alias("n_messages"), lines.alias("messages"))


@query
def delete_conversation(spark, sf_dir):
    """What is left of each history after deletes, with positions that have moved up."""
    return chat.positions(chat.history(_log(spark, sf_dir)))


@query
def clear_history(spark, sf_dir):
    return chat.history(_log(spark, sf_dir, CLEARING))


@query
def recent_conversations(spark, sf_dir):
    log = _log(spark, sf_dir)
    made = chat.recent(chat.history(log, by_loads=False), now=chat.current(log))
    return made.withColumn("shown", F.col("shown").cast("long"))


@query
def error_turns(spark, sf_dir):
    return chat.errors(_log(spark, sf_dir))


@query
def event_time_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.saved_label(F.col("ts")).alias("label"))


@query
def safe_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.safe_label(T.saved_label(F.col("ts"))).alias("label"))
