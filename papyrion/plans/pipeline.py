"""Pages to chunks, end to end, with the cache, the report, and answers from the chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.config import ChunkConfig, RetrievalConfig
from papyrion.functions.text import build_prompt, extract_answer, short_hash, time_label
from papyrion.operators.long_pages import semantic_chunks_of
from papyrion.operators.order import in_order, in_slices, numbered
from papyrion.operators.sizing import overlap_and_bound
from papyrion.operators.split import Embedder, route, split_pages
from papyrion.operators.vectors import embed_texts, top_k_batch, top_k_in_batches
from papyrion.session import stage
from papyrion.sources.cache import KEY, ChunkCache, batch_keys

Generator = Callable[[list[str]], list[str]]

#: Prompts that the generator gets at once.
PROMPTS = 512


def placed_chunks(pages: DataFrame, config: ChunkConfig, embed: Embedder | None = None) -> DataFrame:
    """Chunks as the splitter gives them, in global order; pages are dealt out once, before they are split.

    A batch with a page that the embedder fails on is cut into fixed chunks as a whole.
    """
    routed = route(pages, config, embed)
    order = [F.col("batch_id").asc_nulls_first(), F.col("page_no").asc_nulls_first()]
    made = _split_in_order(routed, order, config, embed)
    if embed is None or config.strategy not in ("hybrid", "semantic"):
        return made.drop("failed")
    # A page that the embedder fails on has its fixed chunks already; to be cut again are batches that have other pages too.
    both = made.groupBy(F.col("batch_id").alias("__batch")).agg(F.max("failed").alias("some"), F.min("failed").alias("all"))
    mixed = stage(both.where("some AND NOT all").select("__batch"), "mixed-batches")
    if mixed.isEmpty():
        return made.drop("failed")
    in_mixed = F.col("batch_id").eqNullSafe(F.col("__batch"))
    whole = in_order(pages.select("batch_id", "page_no", "text").join(mixed, in_mixed, "left_semi"), *order)
    columns = ["batch_id", "page_no", "piece", "start_index", "text"]
    fixed = split_pages(whole, replace(config, strategy="fixed")).select(*columns, F.monotonically_increasing_id().alias("__seq"))
    # The chunks of the other batches stay as they are, and are not embedded again.
    others = made.join(mixed, in_mixed, "left_anti").select(*columns, F.col("place").alias("__seq"))
    again = others.unionByName(stage(fixed, "fixed-chunks"))
    return numbered(in_order(again, order[0], F.col("__seq")).drop("__seq"), name="chunks", counted=False)


#: A page with more characters is split by meaning in many tasks.
LONG_PAGE = 1 << 22


def _split_in_order(routed: DataFrame, order: list, config: ChunkConfig, embed: Embedder | None) -> DataFrame:
    is_long = (F.col("strategy_executed") == "semantic") & (F.coalesce(F.length("text"), F.lit(0)) > LONG_PAGE)
    if embed is None or routed.where(is_long).isEmpty():
        return numbered(split_pages(in_order(routed, *order), config, embed, measure=True), name="chunks", counted=False)
    # Their chunks come in any order, so chunks are put in order in the place of pages.
    pieces = split_pages(routed.where(~is_long), config, embed).unionByName(semantic_chunks_of(routed.where(is_long), config, embed))
    return numbered(in_order(pieces, *order, F.col("piece")), name="chunks", counted=False)


def chunk(pages: DataFrame, config: ChunkConfig = ChunkConfig(), embed: Embedder | None = None) -> DataFrame:
    """(batch_id, ord, sub, page_no, start_index, chunk_index, total_chunks, enhanced, text): split, overlapped, within bounds."""
    made = overlap_and_bound(placed_chunks(pages, config, embed), config)
    return made.select(
        "batch_id", (F.col("place") - F.col("first_place")).alias("ord"), "sub", "page_no", "start_index", "chunk_index", "total_chunks", "enhanced", "text"
    )


def plain_chunks(pages: DataFrame, config: ChunkConfig) -> DataFrame:
    """What remains when anything in `chunk` fails: fixed chunks without overlap or bounds."""
    made = split_pages(pages, ChunkConfig(strategy="fixed", size=config.size, overlap=config.overlap))
    return made.select("batch_id", "page_no", "piece", "start_index", "text")


def chunk_or_plain(
    pages: DataFrame, config: ChunkConfig = ChunkConfig(), embed: Embedder | None = None, chunker: Callable[..., DataFrame] = chunk
) -> tuple[DataFrame, str | None]:
    """Written chunks, and None; or, if making them fails, `plain_chunks` and what went wrong.

    ``chunker`` makes the chunks. Nothing of what failed is kept or put into a cache.
    """
    try:
        return stage(chunker(pages, config, embed), "chunks"), None
    except Exception as e:  # noqa: BLE001  this is the last resort
        return plain_chunks(pages, config), f"{type(e).__name__}: {e}".splitlines()[0]


def cached_chunks(
    pages: DataFrame, cache: ChunkCache, config: ChunkConfig = ChunkConfig(), embed: Embedder | None = None, mode: str = "strict", keys: DataFrame | None = None
) -> DataFrame:
    """`chunk`, but batches whose content and settings are in ``cache`` are read from it, and others put into it.

    An entry that turns out to be damaged as it is read is made again. ``keys``: the staged `batch_keys` of ``pages``, if there are any.
    """
    if keys is None:
        keys = stage(batch_keys(pages, config, mode, embed), "batch-keys")
    columns = ["batch_id", "ord", "sub", "page_no", "start_index", "chunk_index", "total_chunks", "enhanced", "text"]
    for _ in range(2):
        new = stage(cache.misses(keys), "cache-misses")
        if not new.isEmpty():
            # Of batches with equal keys, one is chunked and stands for all.
            chosen = new.groupBy(*KEY).agg(F.min("batch_id").alias("__batch"))
            wanted = pages.join(chosen.select("__batch"), F.col("batch_id").eqNullSafe(F.col("__batch")), "left_semi")
            cache.append(chunk(wanted, config, embed).join(chosen, F.col("batch_id").eqNullSafe(F.col("__batch"))).drop("batch_id", "__batch"))
        found = cache.read(keys)
        if found is None:
            return chunk(pages.limit(0), config, embed).select(*columns)
        # A batch that gives no chunks has no entry; one that had one, and has no more, was damaged.
        if cache.misses(keys).join(new, KEY, "left_anti").isEmpty():
            break
    cache.touch(keys)
    return keys.join(found, KEY).select(*columns)


#: What a batch that comes from the cache is said to have taken, in milliseconds.
HIT_MS = 100


def report(
    pages: DataFrame,
    chunks: DataFrame,
    config: ChunkConfig,
    embed: Embedder | None = None,
    mode: str = "strict",
    cached: DataFrame | None = None,
    took_ms: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """One row per batch: strategy, number of chunks, time, cache hit, short hashes, settings and error.

    ``chunks`` as `chunk` or `chunk_or_plain` gives them, with the latter's ``error``. A batch with chunks in ``cached`` was a hit: its
    time is `HIT_MS`, and its settings are null, as they are where ``error`` is given.
    A null batch is a batch.
    """
    batch = F.col("batch_id")
    routed = route(pages, config, embed).groupBy(batch.alias("b1")).agg(F.first("strategy_reported").alias("strategy"))
    counts = chunks.groupBy(batch.alias("b2")).agg(F.count("*").alias("num_chunks"))
    keys = batch_keys(pages, config, mode, embed)
    hit = F.lit(False)
    if cached is not None and error is None:
        there = cached.select(*[F.col(k).alias(f"c_{k}") for k in KEY], F.lit(True).alias("hit")).distinct()
        keys = keys.join(there, [F.col(k) == F.col(f"c_{k}") for k in KEY], "left")
        hit = F.coalesce("hit", F.lit(False))
    joined = keys.join(routed, batch.eqNullSafe(F.col("b1"))).join(counts, batch.eqNullSafe(F.col("b2")), "left")
    strategy = F.when(hit, "cached").otherwise(F.col("strategy")) if error is None else F.lit("emergency_fallback")
    settings = (("chunk_size", config.size), ("overlap", config.overlap), ("min_size", config.min_size), ("max_size", config.max_size))
    said = F.lit(error is None) & ~hit
    return joined.select(
        "batch_id",
        strategy.alias("strategy"),
        F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        F.when(hit, HIT_MS).otherwise(F.lit(took_ms)).cast("long").alias("took_ms"),
        hit.alias("cache_hit"),
        short_hash(F.col("content_fp")).alias("content_hash"),
        short_hash(F.col("config_fp")).alias("config_hash"),
        *[F.when(said, F.lit(v)).cast("long").alias(c) for c, v in settings],
        F.lit(error).cast("string").alias("error"),
    )


def report_text(reports: DataFrame) -> DataFrame:
    """(batch_id, text): the report as lines; a null part has no line."""
    text = F.col
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"))
    return reports.select(
        "batch_id",
        F.concat_ws(
            "\n",
            line("Strategy", F.coalesce(text("strategy"), F.lit("unknown"))),
            line("Chunks", F.coalesce(text("num_chunks"), F.lit(0))),
            line("Time", time_label(F.coalesce(text("took_ms"), F.lit(0)))),
            line("Cache", F.when(text("cache_hit"), "hit").otherwise("miss")),
            line("Content", text("content_hash")),
            line("Config", text("config_hash")),
            line("Size", text("chunk_size")),
            line("Overlap", text("overlap")),
        ).alias("text"),
    )


def contexts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, context): the texts of the ranked rows, best first, with a blank line between; k texts at most."""
    found = ranked.join(texts.select("vec_id", "text"), "vec_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found")
    )
    return found.select("query_id", F.array_join(F.transform("found", lambda x: x["text"]), "\n\n").alias("context"))


def generate_texts(prompts: DataFrame, generate: Generator) -> DataFrame:
    """``prompts`` with ``reply``; the generator is called with a batch of prompts, and made once per worker if it is lazy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, PROMPTS):
            made = generate(batch.column("prompt").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "reply"])

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())]))


def answer(
    questions: DataFrame, passages: DataFrame, embed: Embedder, generate: Generator, config: RetrievalConfig = RetrievalConfig(), scope: str | None = None
) -> DataFrame:
    """(query_id, question, context, answer) for ``questions`` (query_id, question) over ``passages`` (vec_id, text).

    With ``scope``, a column of both, a question is answered from the passages with its own value of it (a batch, say) alone.
    """
    of = [scope] if scope else []
    index = stage(embed_texts(passages.select("vec_id", "text", *of), embed), "passage-vectors")
    asked = embed_texts(questions.select(F.col("query_id").alias("vec_id"), "question", *of), embed, text="question")
    ranked = top_k_in_batches(index, asked, config, scope) if scope else top_k_batch(index, asked, config)
    joined = questions.join(contexts(ranked, index), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompted = joined.withColumn("prompt", build_prompt(F.col("context"), F.col("question")))
    return generate_texts(prompted, generate).select("query_id", "question", "context", extract_answer(F.col("reply")).alias("answer"))
