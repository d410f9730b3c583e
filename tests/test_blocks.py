"""Overlap and size bounds over blocks, against plain folds over the whole list."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.config import ChunkConfig
from papyrion.operators import order, sizing
from papyrion.operators.split import fixed_chunks
from papyrion.plans import pipeline


def fold(texts, config):
    """(text, index of the first, sub) from left to right."""
    out = []
    for i, t in enumerate(texts):
        if len(t) < config.min_size and out and len(out[-1][0]) + 1 + len(t) <= config.max_size:
            out[-1] = (out[-1][0] + "\n" + t, *out[-1][1:])
        elif len(t) > config.max_size:
            out += [(part, i, sub) for sub, (_, part) in enumerate(fixed_chunks(t, config.size, config.overlap))]
        else:
            out.append((t, i, 0))
    return out


def lapped(texts, config):
    n = config.overlap
    return [(texts[i - 1][-n:] + "\n" if i else "") + t + ("\n" + texts[i + 1][:n] if i + 1 < len(texts) else "") for i, t in enumerate(texts)]


def placed_rows(spark, rows, partitions=4):
    df = spark.createDataFrame([(b, i, t) for i, (b, t) in enumerate(rows)], "batch_id string, page_no long, text string").repartition(3)
    return order.numbered(order.in_order(df, F.col("batch_id").asc_nulls_first(), F.col("page_no"), ranges=partitions))


def batches_of(rows):
    found = {}
    for i, (b, t) in enumerate(rows):
        found.setdefault(b, []).append((i, t))
    return found


CONFIG = ChunkConfig(size=20, overlap=3, min_size=8, max_size=30)


@pytest.mark.parametrize("block, fan", [(100, 2), (700, 3), (4 << 20, 256)])
@pytest.mark.parametrize("kind", ["mixed", "short", "empty", "one batch of short ones"])
def test_blocks_of_any_size_give_the_plain_fold(spark, monkeypatch, block, fan, kind):
    dice = random.Random(kind)
    lengths = {"mixed": (1, 2, 3, 4, 14, 15, 16, 40), "short": (1, 2, 3, 1, 2, 3, 1, 2, 3, 30), "empty": (0, 0, 1), "one batch of short ones": (1, 2, 3)}[kind]
    names = ("a",) if kind.startswith("one") else ("a", "a", "a", "b", None)
    rows = [(dice.choice(names), "w " * n if (n := dice.choice(lengths)) else "") for _ in range(260)]
    monkeypatch.setattr(order, "BLOCK_BYTES", block)
    monkeypatch.setattr(sizing, "FAN", fan)
    placed = placed_rows(spark, rows)
    got = sizing.bound_sizes(placed, CONFIG).orderBy("place", "sub").collect()
    both = sizing.overlap_and_bound(placed, CONFIG).orderBy("place", "sub").collect()
    for batch, found in batches_of(rows).items():
        texts = [t for _, t in found]
        want = [(t, found[i][0], sub) for t, i, sub in fold(texts, CONFIG)]
        assert [(r.text, r.page_no, r["sub"]) for r in got if r.batch_id == batch] == want
        want = [(t, i, sub) for t, i, sub in fold(lapped(texts, CONFIG), CONFIG)]
        mine = [r for r in both if r.batch_id == batch]
        assert [(r.text, r.place - r.first_place, r["sub"]) for r in mine] == want
        assert {r.total_chunks for r in mine} == {len(texts) if len(texts) > 1 else None}
    if block == 100:
        assert placed.select(F.countDistinct("block")).first()[0] > 100


def test_overlap_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_BYTES", 150)
    rows = [("ab"[i % 2], f"text {i} " * (i % 4)) for i in range(120)]
    placed = placed_rows(spark, rows)
    for config in (ChunkConfig(overlap=4), ChunkConfig(overlap=0), ChunkConfig(overlap=0, overlap_zero="off")):
        got = sizing.add_overlap(placed, config).orderBy("place").collect()
        for batch, found in batches_of(rows).items():
            texts = [t for _, t in found]
            want = lapped(texts, config) if config.overlap else texts
            if not config.overlap and config.overlap_zero == "compat":
                want = [(texts[i - 1] + "\n" if i else "") + t + ("\n" if i + 1 < len(texts) else "") for i, t in enumerate(texts)]
            assert [r.text for r in got if r.batch_id == batch] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=9), min_size=1, max_size=6), st.integers(5, 25), st.integers(0, 25))
def test_passages_follow_each_other_as_the_fold_does(blocks, most, entering):
    """Blocks of short chunks only: the function of each, of all together, and a walk chunk by chunk."""
    entry = (min(entering, most), -7, 99)
    passages = [sizing.Passage.of(b, np.minimum(np.array(heads), most), None, most) for b, heads in enumerate(blocks)]
    state = entry
    length, origin = entry[0], entry[1:]
    whole = None
    for b, heads in enumerate(blocks):
        for k, n in enumerate(heads):
            n = min(n, most)
            if length + 1 + n <= most:
                length += 1 + n
            else:
                length, origin = n, (b, k)
        state = passages[b].leave(state)
        whole = passages[b] if whole is None else whole.then(passages[b])
        assert state == (length, *origin) == whole.leave(entry)


def test_a_run_of_very_many_short_chunks_is_spread(spark, monkeypatch):
    """A batch of 300,000 short chunks behind one that is not short: no task has more than its share, and none is without."""
    monkeypatch.setattr(order, "BLOCK_BYTES", 1 << 18)
    monkeypatch.setattr(sizing, "FAN", 16)
    n = 300_000
    rows = spark.range(n, numPartitions=8).select(
        F.lit("b").alias("batch_id"), F.col("id").alias("page_no"), F.when(F.col("id") == 0, F.repeat(F.lit("x"), F.lit(300))).otherwise(F.repeat(F.lit("y"), (F.col("id") * 7919 % 60).cast("int"))).alias("text")
    )
    placed = order.numbered(order.in_order(rows, F.col("batch_id"), F.col("page_no"), ranges=8))
    blocks = placed.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 64).alias("bytes"))
    assert blocks.count() >= 80 and blocks.agg(F.max("bytes")).first()[0] <= (1 << 18) + 364
    made = sizing.bound_sizes(placed, ChunkConfig())
    got = [(r.page_no, r.n) for r in made.select("page_no", F.length("text").alias("n")).orderBy("page_no").collect()]
    want = [(0, 300)]
    for i in range(1, n):
        length = i * 7919 % 60
        if want[-1][1] + 1 + length <= 1500:
            want[-1] = (want[-1][0], want[-1][1] + 1 + length)
        else:
            want.append((i, length))
    assert got == want
    assert made.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))).first()[0] == n - len(want)


def test_the_pipeline_deals_texts_out_twice(spark):
    """Once by ranges of pages, once by block; what follows are joins of small tables."""
    pages = spark.createDataFrame([(f"b{i % 3}", i, "word " * 300) for i in range(60)], "batch_id string, page_no long, text string")
    made = pipeline.chunk(pages, ChunkConfig(strategy="fixed"))
    assert made.count() > 60
    plan = made._jdf.queryExecution().executedPlan().toString()
    # The blocks were dealt out, folded and written before: what is left exchanges no texts by range or block.
    assert "rangepartitioning" not in plan and "home" not in plan and "FileScan parquet [__row" in plan
