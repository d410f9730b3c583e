"""Context from neighbouring chunks, and bounds on the size of chunks.

Both take chunks in global order (`order.numbered`), so a batch of any size is
spread over the tasks. Chunks are dealt out once, by block (a run of them with half a megabyte of text); the
chunks beside a block go along, so a task has all that a block needs and holds one block.

Size bounds, from left to right in a batch: a chunk shorter than ``min_size`` is
put behind the last one, with a line feed, if both together do not exceed
``max_size``; a chunk above ``max_size`` gives way to its fixed chunks; others stay.
A chunk that is not short does not depend on what came before, so a task folds its block from
the first such chunk on. Open are only the block's last group, which what follows may join, and
the short chunks at its head. Where there are any at some head:

* Where the next group begins is a pointer, found by binary search in the prefix sums of lengths; following the
  pointers by doubling gives the last group that begins in a block. So a block is a function from the length of the group
  that enters it to that of the group that leaves it (`Passage`): a constant, or, for a block of short
  chunks only, a table of ``max_size`` + 1 numbers.
* Functions of `FAN` blocks that follow each other are put together, and those again, until few
  are left; from the top down, each block then learns what enters it.
* With that, each block finds its true starts, and the open chunks are gathered by group.

So a run of a million short chunks is the work of all tasks.

Defined results: nulls in carried columns stay, a null text is empty; a batch of one chunk gets no context
and null context columns; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.config import ChunkConfig
from papyrion.operators.order import with_counts
from papyrion.operators.split import fixed_chunks
from papyrion.session import stage

#: Functions that are put together at once, and that come to the driver at most.
FAN = 256
_BLOCKS = ("block", "block_before", "block_after", "part")
#: Kinds of rows of a block: done, the last group, and a chunk at the head that may join what comes before.
_DONE, _LAST, _HEAD = 0, 1, 2


def _with_context(texts: list[str], same: list[bool], config: ChunkConfig) -> list[str]:
    """Each text with its neighbours' ends; ``same[i]``: is text i - 1 of the same batch?"""
    n = config.overlap
    if n == 0 and config.overlap_zero == "off":
        return texts
    out = []
    for i, text in enumerate(texts):
        # With an overlap of 0 the whole text before is put in front.
        head = (texts[i - 1][-n:] if n else texts[i - 1]) + "\n" if same[i] else ""
        tail = "\n" + texts[i + 1][:n] if i + 1 < len(texts) and same[i + 1] else ""
        out.append(f"{head}{text}{tail}")
    return out


def _block_work(config: ChunkConfig, overlap: bool, bound: bool):
    """Rows (home, row, batch, own, text), sorted, to rows (row, sub, text, kind, block, k, n)."""
    names = ["__row", "sub", "text", "kind", "block", "k", "n"]

    def folded(rows: pa.Table) -> pa.RecordBatch:
        texts, own = [t or "" for t in rows.column(4).to_pylist()], rows.column(3).to_pylist()
        batches = rows.column(2).to_pylist()
        same = [i > 0 and batches[i] == batches[i - 1] for i in range(len(batches))]
        whole = _with_context(texts, same, config) if overlap else texts
        # (row, sub, texts, length, may it join?) of the block's own chunks, after those above the bound are split
        units: list[tuple[int, int, str, bool]] = []
        for i in range(len(texts)):
            if not own[i]:
                continue
            n = len(whole[i])
            if bound and n > config.max_size:
                units += [(i, sub, part, False) for sub, (_, part) in enumerate(fixed_chunks(whole[i], config.size, config.overlap))]
            else:
                units.append((i, 0, whole[i], bound and n < config.min_size and same[i]))
        head = next((k for k, u in enumerate(units) if not u[3]), len(units))
        made = [(i, sub, text, _HEAD, k, len(text)) for k, (i, sub, text, _) in enumerate(units[:head])]
        held: list[str] = []
        start, length = head, 0
        for k in range(head, len(units) + 1):
            if k < len(units) and held and units[k][3] and length + 1 + len(units[k][2]) <= config.max_size:
                held.append(units[k][2])
                length += 1 + len(units[k][2])
                continue
            if held:
                i, sub, *_ = units[start]
                made.append((i, sub, "\n".join(held), _LAST if bound and k == len(units) else _DONE, start, length))
            if k < len(units):
                held, start, length = [units[k][2]], k, len(units[k][2])
        at, *columns = zip(*made) if made else ((),) * 6
        home = rows.column(0)[0].as_py()
        kinds = (pa.int32(), pa.string(), pa.int8(), pa.int32(), pa.int32())
        sub, text, kind, k, n = (pa.array(c, t) for c, t in zip(columns, kinds))
        row = rows.column(1).combine_chunks().take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([row, sub, text, kind, pa.array([home] * len(made), pa.int64()), k, n], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            homes = batch.column(0).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)] if len(homes) else [0]
            for a, b in zip(borders, borders[1:]):
                if held and held[0].column(0)[0].as_py() != homes[a]:
                    yield folded(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield folded(pa.Table.from_batches(held))

    return run


def _in_blocks(placed: DataFrame, config: ChunkConfig, overlap: bool, bound: bool) -> DataFrame:
    kept = [c for c in placed.columns if c not in ("text", *_BLOCKS)]
    # The block of a row, and those beside it if the row stands at a border.
    beside = [F.when(F.col(c) != F.col("block"), F.col(c)) for c in ("block_before", "block_after")]
    homes = F.explode(F.array_compact(F.array("block", *beside))).alias("home")
    spread = placed.select(homes, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "batch_id", "block", F.col("text").cast("string").alias("text"))
    shaped = spread.select("home", "__row", "batch_id", (F.col("home") == F.col("block")).alias("own"), "text")
    dealt = shaped.repartition("home").sortWithinPartitions("home", "__row.place")
    fields = T.StructType.fromDDL("sub int, text string, kind byte, block long, k int, n int").fields
    made = dealt.mapInArrow(_block_work(config, overlap, bound), T.StructType([shaped.schema["__row"], *fields]))
    if not bound:
        return made.select("__row.*", "text")
    made = stage(made, "folded-blocks")
    if made.where(F.col("kind") == _HEAD).isEmpty():
        return made.select("__row.*", "sub", "text")
    groups = _groups(made.where(F.col("kind") != _DONE).select("block", "k", "n", "kind"), config.max_size)
    opened = made.where(F.col("kind") != _DONE).join(groups, ["block", "k"])
    # A group has no more than max_size characters.
    gathered = opened.groupBy("group_block", "group_k").agg(F.array_sort(F.collect_list(F.struct("block", "k", "sub", "text"))).alias("all"), F.min_by("__row", F.struct("block", "k")).alias("__row"))
    merged = gathered.select("__row", F.get("all", F.lit(0))["sub"].alias("sub"), F.array_join(F.transform("all", lambda u: u["text"]), "\n").alias("text"))
    return made.where(F.col("kind") == _DONE).select("__row", "sub", "text").unionByName(merged).select("__row.*", "sub", "text")


@dataclass
class Passage:
    """What leaves a run of blocks for each length of the group that enters it: its length, and the block and number of the chunk that it begins with.

    The number is -1 if it is the group that entered. One entry alone holds whatever enters.
    """

    length: np.ndarray
    block: np.ndarray
    k: np.ndarray

    @staticmethod
    def of(block: int, heads: np.ndarray, last: tuple[int, int] | None, most: int) -> Passage:
        """``heads``: lengths of the short chunks at the head; ``last``: number and length of the last group that begins in the block, or None."""
        if last:
            return Passage(*(np.array([v]) for v in (min(last[1], most), block, last[0])))
        sums = np.cumsum(heads + 1)
        m = len(heads)
        last_start = _starts(heads, sums, most)
        last_start = np.where(last_start < m, last_start, np.arange(m))
        while (further := last_start[last_start]).tolist() != last_start.tolist():
            last_start = further
        entering = np.arange(most + 1)
        first = np.searchsorted(sums, most - entering, "right")
        start = last_start[np.minimum(first, m - 1)]
        through = first == m
        return Passage(
            np.where(through, entering + sums[-1], np.minimum(heads[start] + sums[-1] - sums[start], most)), np.where(through, -1, block), np.where(through, -1, start)
        )

    def then(self, other: Passage) -> Passage:
        if len(other.length) == 1:
            return other
        own = other.k[self.length] >= 0
        return Passage(other.length[self.length], np.where(own, other.block[self.length], self.block), np.where(own, other.k[self.length], self.k))

    def leave(self, entry: tuple[int, int, int]) -> tuple[int, int, int]:
        """What leaves, if ``entry`` (length, block, number) enters."""
        i = entry[0] if len(self.length) > 1 else 0
        return (int(self.length[i]), *((int(self.block[i]), int(self.k[i])) if self.k[i] >= 0 else entry[1:]))


def _starts(heads: np.ndarray, sums: np.ndarray, most: int) -> np.ndarray:
    """For each chunk, where the next group begins if a group begins with it."""
    return np.searchsorted(sums, most - heads + sums, "right")


_PASSAGE = "length array<int>, origin array<long>, number array<int>"


def _passages(ids: list[int], found: list[Passage], name: str) -> pa.RecordBatch:
    lists = [pa.array([getattr(p, c).tolist() for p in found], pa.list_(t)) for c, t in (("length", pa.int32()), ("block", pa.int64()), ("k", pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], [name, "length", "origin", "number"])


def _passage(row: dict) -> Passage:
    return Passage(*(np.array(row[c], np.int64) for c in ("length", "origin", "number")))


def _entries(passages: DataFrame) -> DataFrame:
    """(id, length, origin, number) of what enters each of ``passages`` (id and what `_PASSAGE` names), by rising id."""
    spark = passages.sparkSession
    shape = "id long, entry_length int, entry_block long, entry_k int"

    def walk(rows: list[dict], entry: tuple[int, int, int]) -> list[tuple]:
        out = []
        for row in rows:
            out.append((row["id"], *entry))
            entry = _passage(row).leave(entry)
        return out

    if passages.count() <= FAN:
        rows = sorted((r.asDict() for r in passages.collect()), key=lambda r: r["id"])
        return spark.createDataFrame(walk(rows, (0, -1, -1)), shape)

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        whole = _passage(rows[0])
        for row in rows[1:]:
            whole = whole.then(_passage(row))
        return pa.Table.from_batches([_passages([rows[0]["parent"]], [whole], "id")])

    def down(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        found = walk(rows, tuple(rows[0][c] for c in ("entry_length", "entry_block", "entry_k")))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["id", "entry_length", "entry_block", "entry_k"])

    parented = passages.withColumn("parent", F.floor(F.col("id") / FAN))
    above = stage(parented.groupBy("parent").applyInArrow(joined, f"id long, {_PASSAGE}"), "passages")
    known = _entries(above).withColumnRenamed("id", "parent")
    return stage(parented.join(known, "parent").groupBy("parent").applyInArrow(down, shape), "entries")


def _groups(opened: DataFrame, most: int) -> DataFrame:
    """(block, k, group_block, group_k): the chunk with which the group of each open one begins."""
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == _HEAD, F.struct("k", "n")))), lambda h: h["n"]).alias("heads")
    last = F.max(F.when(F.col("kind") == _LAST, F.struct("k", "n"))).alias("last")
    blocks = stage(opened.groupBy("block").agg(heads, last), "open-blocks")

    def pass_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [Passage.of(r["block"], np.array(r["heads"], np.int64), (r["last"]["k"], r["last"]["n"]) if r["last"] else None, most) for r in rows]
            yield _passages([r["block"] for r in rows], made, "id")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for r in batch.to_pylist():
                n = np.array(r["heads"], np.int64)
                sums = np.cumsum(n + 1)
                pointer = _starts(n, sums, most).tolist()
                at, group = 0, (r["entry_block"], r["entry_k"])
                end = int(np.searchsorted(sums, most - r["entry_length"], "right"))
                while at < len(n):
                    found += [(r["block"], k, *group) for k in range(at, end)]
                    at, group = end, (r["block"], end)
                    end = pointer[at] if at < len(n) else at
                if r["last"]:
                    found.append((r["block"], r["last"]["k"], r["block"], r["last"]["k"]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, kinds)], ["block", "k", "group_block", "group_k"])

    passages = stage(blocks.mapInArrow(pass_through, f"id long, {_PASSAGE}"), "passages")
    entered = blocks.join(_entries(passages).withColumnRenamed("id", "block"), "block")
    return entered.mapInArrow(assign, "block long, k int, group_block long, group_k int")


def _context_columns(rows: DataFrame) -> DataFrame:
    several = F.col("batch_rows") > 1
    return rows.withColumns(
        {
            "chunk_index": F.when(several, (F.col("place") - F.col("first_place")).cast("int")),
            "total_chunks": F.when(several, F.col("batch_rows").cast("int")),
            "enhanced": F.when(several, F.lit(True)),
        }
    )


def add_overlap(placed: DataFrame, config: ChunkConfig) -> DataFrame:
    """Each chunk between the end of the one before and the head of the one after, with ``chunk_index``, ``total_chunks``, ``enhanced``."""
    return _context_columns(_in_blocks(placed, config, overlap=True, bound=False))


def bound_sizes(placed: DataFrame, config: ChunkConfig) -> DataFrame:
    """Chunks within the bounds, as far as the rules give; ``sub`` numbers the parts of a chunk that was split."""
    return _in_blocks(placed, config, overlap=False, bound=True)


def overlap_and_bound(placed: DataFrame, config: ChunkConfig) -> DataFrame:
    """Both, in one pass over each block; ``placed`` need not be counted, since what the batches count is joined to the result."""
    made = _in_blocks(placed, config, overlap=True, bound=True)
    return _context_columns(made if "batch_rows" in made.columns else with_counts(made, placed))
