"""Chunks by meaning of pages of any length, each page the work of many tasks.

`split.semantic_chunks` says what the chunks are, page by page; this gives the same ones sentence by sentence:

1. A page is cut into blocks of sentences of about `BLOCK_CHARS` characters, which take along the sentences that their
   windows reach beyond them, and the blocks are dealt out.
2. A block embeds its own windows and gives the distance of each sentence from the next.
3. The percentile of a page's distances is found exactly by counting: distances have nine digits, so they are whole
   numbers, and three rounds of counts, of ever narrower ranges around the two ranks that are wanted, give them.
4. A chunk ends at a distance above the percentile, unless it is too short. So a block is a function from the length of the
   chunk that enters it (as far as it matters, up to ``min_size``) to that of the one that leaves it, found by pointers
   from each possible end to the next; a page's functions, some bytes for each block, are followed from its first to its last block.
5. Each block then knows where its chunks begin, and the parts of chunks that lie in several blocks are put together.

A page is one value, of 2 GB at most, so it has some thousands of blocks at most.

Defined results: as those of `split.split_pages`; a page with a block that the embedder fails on gets fixed chunks, marked ``failed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.operators.order import in_slices
from papyrion.operators.split import Embedder, cosine_distances, sentences_of, split_pages
from papyrion.session import stage

#: Characters of the sentences of a block, about.
BLOCK_CHARS = 1 << 18
#: Blocks of sentences that a task has as objects at once.
BLOCKS_AT_ONCE = 32
#: Distances as whole numbers, and the bits by which the ranges of each round of counts are narrower.
_UNITS, _ROUNDS = 1_000_000_000, (20, 10, 0)
_PAGE = ["page"]


def _blocks(buffer: int, size: int):
    """Rows (page, text) to (page, block, first, of, own, sentences): sentences of a block, ``own`` of them from number ``first``, with those around them."""
    names = ["page", "block", "first", "of", "own", "lead", "sentences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sentences = sentences_of(text.as_py() or "")
                low, block, n = 0, 0, len(sentences)
                while low < n:
                    high, held = low, 0
                    while high < n and (high == low or held < size):
                        held += len(sentences[high]) + 1
                        high += 1
                    a, b = max(0, low - buffer), min(n, high + buffer + 1)
                    row = [[page], [block], [low], [n], [high - low], [low - a], [sentences[a:b]]]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names)
                    low, block = high, block + 1

    return run


def _distances(buffer: int, embed: Embedder):
    """Blocks to (page, block, failed, distances to the next sentence of each own one that has one, as whole numbers)."""

    def of(row: dict) -> tuple:
        around, lead, own = row["sentences"], row["lead"], row["own"]
        # With the sentence behind the last own one, if the page has it.
        last = lead + own + (row["first"] + own < row["of"])
        windows = [" ".join(around[max(0, i - buffer) : i + buffer + 1]) for i in range(lead, last)] if row["of"] > 1 else []
        try:
            vectors = np.asarray(embed(windows), np.float64) if windows else np.empty((0, 0))
            if len(vectors) != len(windows):
                raise ValueError("the embedder gives another number of vectors than texts")
        except Exception:  # noqa: BLE001  whatever a model raises
            return row["page"], row["block"], True, []
        found = cosine_distances(vectors) if len(vectors) > 1 else np.empty(0)
        return row["page"], row["block"], False, np.rint(found * _UNITS).astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        for batch in in_slices(batches, BLOCKS_AT_ONCE):
            made = list(zip(*map(of, batch.to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], ["page", "block", "failed", "distances"])

    return run


def _limits(measured: DataFrame, percent: float) -> DataFrame:
    """(page, limit): the percentile of each page's distances, linear between the two values beside it."""
    values = measured.select("page", F.explode("distances").alias("d"))
    counts = values.groupBy("page").agg(F.count("*").alias("m"))
    at = (F.col("m") - 1) * F.lit(percent / 100)
    # Two ranks for each page, and what is known of them: they lie in ``range`` (of the width of the round before), ``rank`` of it.
    wanted = counts.select("page", at.alias("at"), F.floor(at).alias("low"), F.least(F.floor(at) + 1, F.col("m") - 1).alias("high"))
    ranks = wanted.select("page", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("low").alias("rank")), F.struct(F.lit(1).alias("which"), F.col("high").alias("rank")))).alias("r"))
    known = stage(ranks.select("page", "r.which", "r.rank", F.lit(0).cast("long").alias("range")), "ranks")
    before = 62
    for bits in _ROUNDS:
        inside = values.join(known.select("page", "range").distinct(), (values["page"] == known["page"]) & (F.shiftright("d", before) == known["range"])).select(values["page"], "d")
        ranges = inside.groupBy("page", F.shiftright("d", before).alias("range"), F.shiftright("d", bits).alias("narrow")).agg(F.count("*").alias("n"))
        # A page has at most some thousands of ranges in a round, sorted by page.
        joined = known.join(ranges, ["page", "range"]).groupBy("page", "which", "rank").agg(F.array_sort(F.collect_list(F.struct("narrow", "n"))).alias("all"))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("narrow"), F.lit(None).cast("long").alias("rank"))
        found = F.aggregate(
            "all",
            start,
            lambda s, x: F.struct(
                (s["sum"] + x["n"]).alias("sum"),
                F.when(s["narrow"].isNull() & (F.col("rank") < s["sum"] + x["n"]), x["narrow"]).otherwise(s["narrow"]).alias("narrow"),
                F.when(s["narrow"].isNull() & (F.col("rank") < s["sum"] + x["n"]), F.col("rank") - s["sum"]).otherwise(s["rank"]).alias("rank"),
            ),
        ).alias("f")
        known = stage(joined.select("page", "which", found).select("page", "which", F.col("f.rank").alias("rank"), F.col("f.narrow").alias("range")), "ranks")
        before = bits
    both = known.groupBy("page").agg(F.max(F.when(F.col("which") == 0, F.col("range"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("range"))).alias("b")).join(wanted, "page")
    a, b, t = F.col("a") / F.lit(float(_UNITS)), F.col("b") / F.lit(float(_UNITS)), F.col("at") - F.col("low")
    # From the nearer end, as numpy does.
    return both.select("page", F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t)).alias("limit"))


def _ends(lengths: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of lengths (with what joins them) up to each cut, for each cut the one at which a chunk that begins behind it ends, and the sums up to each sentence."""
    sums = np.cumsum(lengths + 1)
    at = sums[cuts]
    return at, np.searchsorted(at, least + 1 + at), sums


def _functions(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(page, block, lengths, cuts) to what leaves a block for each length that enters it: a length, and if it is of a chunk that begins in the block."""
    for batch in in_slices(batches, BLOCKS_AT_ONCE):
        out = []
        for row in batch.to_pylist():
            lengths, cuts = np.array(row["lengths"], np.int64), np.array(row["cuts"], np.int64)
            at, pointer, sums = _ends(lengths, cuts, least)
            entering = np.arange(least + 2)
            first = np.searchsorted(at, least + 1 - entering)
            last = np.where(pointer < len(cuts), pointer, np.arange(len(cuts)))
            while len(last) and (further := last[last]).tolist() != last.tolist():
                last = further
            through = first == len(cuts)
            end = last[np.minimum(first, len(cuts) - 1)] if len(cuts) else np.zeros(len(entering), np.int64)
            left = np.where(through, entering + sums[-1], sums[-1] - (at[end] if len(cuts) else 0))
            out.append((row["page"], row["block"], len(lengths), int(lengths.sum()), np.minimum(left, least + 1).tolist(), [bool(x) for x in ~through]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], ["page", "block", "n", "chars", "leaves", "begun"])


def _followed(table: pa.Table) -> pa.Table:
    """What enters each block of a page: the length of the open chunk, and its block; and the sentences and characters before."""
    out, held, block, sentences, chars = [], 0, 0, 0, 0
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append((row["page"], row["block"], held, block, sentences, chars))
        if not held or row["begun"][held]:  # with nothing open, the block begins with a chunk
            block = row["block"]
        held = row["leaves"][held]
        sentences, chars = sentences + row["n"], chars + row["chars"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page", "block", "entry", "opened", "sentences_before", "chars_before"])


def _parts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blocks with entries to parts of chunks: (page, block, number in the block, home, begins, sentences and characters before, text).

    Number 0 is the chunk that enters the block; it is at ``home``, the block that it begins in, where it is the last.
    """
    names = ["page", "block", "number", "home", "sentence", "chars", "text"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    for batch in in_slices(batches, BLOCKS_AT_ONCE):
        out = []
        for row in batch.to_pylist():
            own = row["sentences"][row["lead"] : row["lead"] + row["own"]]
            lengths, cuts = np.array([len(s) for s in own], np.int64), np.array(row["cuts"], np.int64)
            at, pointer, sums = _ends(lengths, cuts, least)
            ends, k = [], int(np.searchsorted(at, least + 1 - row["entry"]))
            while k < len(cuts):
                ends.append(int(cuts[k]) + 1)
                k = int(pointer[k])
            borders = [0, *ends]
            for number, (a, b) in enumerate(zip(borders, [*ends, len(own)])):
                if a == b:  # the block ends with a chunk
                    continue
                entered = number == 0 and row["entry"] > 0
                before = int(lengths[:a].sum())
                out.append((row["page"], row["block"], 0 if entered else number + 1, row["opened"] if entered else row["block"], row["sentences_before"] + a, row["chars_before"] + before, " ".join(own[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], names)


def _counted(table: pa.Table) -> pa.Table:
    """The chunks that begin before each block of a page, and the number of the last that begins in it."""
    out, before = [], 0
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append((row["page"], row["block"], before))
        before += row["n"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], ["page", "block", "pieces_before"])


def semantic_chunks_of(pages: DataFrame, config: ChunkConfig, embed: Embedder, block: int | None = None) -> DataFrame:
    """(batch_id, page_no, piece, start_index, failed, text) of ``pages`` (batch_id, page_no, text), in any order.

    Every page is split by meaning; ``block`` is the size of a block, `BLOCK_CHARS` if it is not given.
    """
    least, size, buffer = config.min_size, block or BLOCK_CHARS, config.buffer
    # Written with a number, so that a page keeps it.
    named = stage(pages.select("batch_id", "page_no", F.col("text").cast("string").alias("text")).withColumn("page", F.monotonically_increasing_id()), "long-pages")
    cut = named.select("page", "text").mapInArrow(_blocks(buffer, size), "page long, block int, first long, of long, own int, lead int, sentences array<string>")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stage(cut.repartition(n, "page", "block"), "sentence-blocks")
    measured = stage(blocks.mapInArrow(_distances(buffer, embed), "page long, block int, failed boolean, distances array<long>"), "distances")
    failed = stage(measured.where("failed").select("page").distinct(), "failed-pages")
    limits = stage(_limits(measured, config.threshold), "limits")
    ends = measured.join(limits, "page", "left")
    above = lambda d: d / F.lit(float(_UNITS)) > F.col("limit")
    places = F.sequence(F.lit(0), F.size("distances") - 1)
    cuts = F.when(F.size("distances") > 0, F.filter(places, lambda i: above(F.get("distances", i)))).otherwise(F.array().cast("array<int>"))
    ended = stage(ends.join(failed, "page", "left_anti").select("page", "block", cuts.alias("cuts")), "possible-ends")
    own = F.transform(F.slice("sentences", F.col("lead") + 1, F.col("own")), lambda s: F.length(s))
    lengths = blocks.select("page", "block", own.alias("lengths")).join(ended, ["page", "block"])
    functions = lengths.select("page", "block", "lengths", "cuts").mapInArrow(
        lambda b: _functions(b, least), "page long, block int, n int, chars long, leaves array<int>, begun array<boolean>"
    )
    entered = functions.groupBy("page").applyInArrow(_followed, "page long, block int, entry int, opened int, sentences_before long, chars_before long")
    ready = blocks.join(stage(ended.join(entered, ["page", "block"]), "block-entries"), ["page", "block"])
    chosen = ready.select("page", "block", "own", "lead", "sentences", "cuts", "entry", "opened", "sentences_before", "chars_before")
    parts = stage(chosen.mapInArrow(lambda b: _parts(b, least), "page long, block int, number int, home int, sentence long, chars long, text string"), "chunk-parts")
    begun = parts.where("number > 0")
    # Of each block with a chunk that begins in it: how many do, and how many before.
    per_block = begun.groupBy("page", "block").agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("last"))
    before = per_block.groupBy("page").applyInArrow(_counted, "page long, block int, pieces_before long").join(per_block.select("page", "block", "least", "last"), ["page", "block"])
    before = stage(before.withColumnsRenamed({"block": "home"}), "pieces-before")
    # A part that goes on belongs to the last chunk that begins in its home.
    placed = parts.join(before, ["page", "home"]).withColumn("piece", F.col("pieces_before") + F.when(F.col("number") > 0, F.col("number") - F.col("least")).otherwise(F.col("last") - F.col("least")))
    whole = placed.groupBy("page", "piece").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("all"), F.min(F.struct("block", "sentence", "chars")).alias("at")
    )
    # The lengths of the chunks before add up to their characters and what joins their sentences.
    start = F.col("at.chars") + F.col("at.sentence") - F.col("piece")
    text = F.array_join(F.transform("all", lambda p: p["text"]), " ")
    about = named.select("page", "batch_id", "page_no")
    made = whole.select("page", F.col("piece").cast("int").alias("piece"), start.cast("int").alias("start_index"), F.lit(False).alias("failed"), text.alias("text")).join(about, "page")
    plain = split_pages(named.join(failed, "page", "left_semi"), ChunkConfig(strategy="fixed", size=config.size, overlap=config.overlap))
    columns = ["batch_id", "page_no", "piece", "start_index", "failed", "text"]
    return made.select(*columns).unionByName(plain.withColumn("failed", F.lit(True)).select(*columns))
