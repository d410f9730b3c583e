"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the whole dialogue is rendered once, with
that speaker as assistant and all others as named users, and with the places the
assistant's own words take as the mask to train on. A turn becomes

    <|user:NAME|>\\nTEXT<|end|>\\n      or      <|assistant|>\\nTEXT<|end|>\\n

and the mask covers ``TEXT<|end|>`` of the assistant's turns. Turns of a role in
`CONTEXT_ROLES` are rendered as ``<|system|>`` in every view and have no view of
their own.

A long conversation is given in windows of `WINDOW_TURNS` turns, numbered from 0, and
a window in as many parts as stretches of `WINDOW_CHARS` characters of the conversation's texts begin or go on in
it (a turn belongs to the stretch that its text begins in, and ``part`` is the number of the stretch, which
does not start afresh with a window). So no value holds more than that and one turn: turns are sorted by ranges (a hot
conversation spreads over many tasks), numbered by the rows of the tasks before,
and only then gathered, part by part. Joined in order, the parts of a
view are the whole dialogue, and ``char_start`` says where each begins.

Defined results: null text is empty; a null or blank role is the speaker
``unknown``; turns sort by (turn, role, text) with nulls first; repeated rows are
repeated turns; rows with a null conversation id make up one conversation; a
conversation of context turns only has no participant and gives no rows; ids and turns must be
whole numbers; extra
columns are not carried; empty table in, empty table out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.llm.common import number
from papyrion.session import stage

CONTEXT_ROLES = ("system",)
WINDOW_TURNS = 256
WINDOW_CHARS = 1 << 22
UNKNOWN = "unknown"
_TURN_END = "<|end|>\n"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the characters of the rows before in the task."""
    so_far = 0
    for batch in batches:
        sizes = np.asarray(batch.column("chars"), np.int64)
        ends = so_far + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes)], [*batch.schema.names, "chars_before"])
        so_far = int(ends[-1]) if len(ends) else so_far


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``place`` and ``chars_before``, the rows and characters before each in the order of conversation and turn."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges end between different starts of texts, so the bounds stay short and the order is that of whole texts.
    dealt = turns.repartitionByRange(n, *order[:3], F.substring("text", 1, 32))
    dealt = dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = stage(dealt.mapInArrow(_summed, T.StructType([*dealt.schema.fields, T.StructField("chars_before", T.LongType())])), "turns")
    part = F.shiftright("at", 33)
    # One row per task, so the window over all of them is small.
    sizes = held.groupBy(part.alias("task")).agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = sizes.select("task", earlier("rows").alias("rows_base"), earlier("chars").alias("chars_base"))
    return held.withColumn("task", part).join(F.broadcast(bases), "task").select(
        "conv_id", "turn", "role", "text", "chars",
        (F.col("rows_base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"),
        (F.col("chars_base") + F.col("chars_before")).alias("chars_before"),
    )


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW_TURNS, chars: int = WINDOW_CHARS
) -> DataFrame:
    """One row per conversation, participant, window of turns and part of it.

    Columns: ``conv_id``, ``participant``, ``window``, ``part``, ``n_turns``, ``char_start``,
    ``rendered``, and ``mask``, an array of (start, end) in ``rendered``, in code
    points, the end exclusive.
    """
    speaker = F.when(F.trim(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))) == "", UNKNOWN).otherwise(F.col(f"`{role}`").cast("string"))
    plain = turns.select(
        number(turns, conv).alias("conv_id"),
        number(turns, turn).alias("turn"),
        speaker.alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    placed = stage(_numbered(plain.withColumn("chars", F.length("text"))), "placed-turns")
    # Joins on (id or 0, is it null?), since null equals nothing.
    key = [F.coalesce("conv_id", F.lit(0)).alias("k"), F.col("conv_id").isNull().alias("none")]
    placed = placed.select("*", *key)
    # A row for each participant, so a conversation of very many speakers is no long array.
    begins = placed.groupBy("k", "none").agg(F.min("place").alias("first"), F.min("chars_before").alias("first_chars"))
    spoken = placed.where(~F.col("role").isin(*CONTEXT_ROLES)).select("k", "none", F.col("role").alias("participant")).distinct()
    about = stage(spoken.join(begins, ["k", "none"]), "participants")
    seen = placed.join(about, ["k", "none"]).select(
        "conv_id", "k", "none", "role", "text", "chars", (F.col("place") - F.col("first")).alias("i"), "participant",
        F.floor((F.col("chars_before") - F.col("first_chars")) / chars).alias("part"),
    )
    own = F.col("role") == F.col("participant")
    head = (
        F.when(F.col("role").isin(*CONTEXT_ROLES), F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n")))
    )
    parts = seen.select(
        "conv_id", "k", "none", "participant", F.floor(F.col("i") / window).alias("window"), "part", "i",
        F.concat(head, "text", F.lit(_TURN_END)).alias("said"),
        (F.length(head) + F.col("chars") + len(_TURN_END)).alias("size"),
        own.alias("own"),
        F.length(head).alias("head"),
    )
    by = ["k", "none", "participant", "window", "part"]
    gathered = parts.groupBy(*by).agg(
        F.first("conv_id").alias("conv_id"),
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("i", "said", "own", "head"))).alias("turns"),
    )
    # A number for each window: only these, and not the texts, are put in order by conversation.
    sizes = parts.groupBy(*by).agg(F.sum("size").alias("chars"))
    earlier = Window.partitionBy("k", "none", "participant").orderBy("window", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("char_start"))
    started = gathered.join(starts, by)
    return started.select(
        "conv_id", "participant", "window", "part", "n_turns", "char_start",
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("rendered"),
        _mask("turns").alias("mask"),
    )


def _mask(turns: str) -> Column:
    """(start, end) of the own turns' words, from a running length."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done, t):
        after = done["at"] + F.length(t["said"])
        # The line feed behind <|end|> is not part of what is trained.
        span = F.struct((done["at"] + t["head"]).alias("start"), (after - 1).alias("end"))
        return F.struct(after.alias("at"), F.when(t["own"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rotate(turns).select("conv_id", "participant", "window", "part", "n_turns", "char_start", "rendered", spans.alias("mask"))


#: DuckDB SQL of the same rows.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text
  FROM conversations),
n AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4194304 AS part
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
v AS (
  SELECT n.conv_id, participant, i, i // 256 AS win, part, n.role = participant AS own,
         CASE WHEN n.role = 'system' THEN '<|system|>' WHEN n.role = participant THEN '<|assistant|>'
              ELSE '<|user:' || n.role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (
  SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, participant, win, part ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM v),
g AS (
  SELECT conv_id, participant, win, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY i) AS rendered,
         coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head || body) - 1)::BIGINT, ',' ORDER BY i) FILTER (own), '') AS mask
  FROM c GROUP BY conv_id, participant, win, part)
SELECT conv_id, participant, win::BIGINT AS "window", part::BIGINT AS part, n_turns, rendered, mask,
       coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, participant ORDER BY win, part
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
FROM g
"""
