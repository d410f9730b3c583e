"""Packing documents into sequences of bounded length, in order, by dynamic programming.

A task reads its rows in order and lays their tokens end to end. A sequence may
end at the end of a document, which costs nothing, or of a sentence, which costs a
truncation penalty; only a sentence that is longer than a whole sequence may be
cut inside, at multiples of `GRID` tokens, at a higher penalty. Besides, a sequence
costs its padding. With the token positions of the allowed cuts

    cost(j) = penalty(j) + min over i of cost(i) + capacity - (pos(j) - pos(i)),  0 < pos(j) - pos(i) <= capacity

so the best i minimises ``cost(i) + pos(i)`` over a window that only moves
forward. Of the queue of such i, which rises from its front, only the front is ever needed
(see `Cuts`): it is taken anew when it falls out of the window, and serves all j until
then. A sequence whose length is a power of two needs no padding; the larger of those
lengths are looked up apart.

The program runs over the whole stream of a task. A cut is given out as soon as it is on
the best path to every place where the next sequence could still begin, so
tokens are held for a few sequences only, and the cuts are those that a look at
the whole stream would give, however it comes in batches. There is no shuffle: each input
partition is packed on its own, in the order that its rows are read in (that of
the files, not that of ids), and ``sequence_id`` holds its number in the upper bits.

Where sentences end is said in `tokens`.

Defined results: null or empty text is a document of its end token alone; ids may be of any type, and a null
id stays null; repeated rows are packed as often as they come; extra columns are
not carried (rows are pieces, not documents); empty table in, empty table out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.llm import tokens

CAPACITY = 2048
#: Cost, in tokens of padding, of ending a sequence after a sentence, or inside one that fits no sequence.
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 12
#: Cost of starting a sequence at all, so that short ones are not made for nothing.
SEQUENCE_PENALTY = 2
#: A sentence longer than a sequence may be cut at multiples of this, counted from its start.
GRID = 64
#: The shortest sequence that is made to end at a power of two for the sake of its padding.
LEAST_POWER = 256

PIECES = "start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def allowed_cuts(ends: np.ndarray, sentences: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, penalty) of the allowed cuts of a run of documents that begins at 0, by rising position.

    ``ends``: of documents, ``sentences``: of sentences, both as rising numbers of tokens before.
    """
    at = np.sort(np.concatenate([ends, sentences]), kind="stable")
    at = at[np.diff(at, prepend=0) > 0]
    starts, gaps = np.concatenate([[0], at[:-1]]), np.diff(at, prepend=0)
    penalty = np.full(len(at), SENTENCE_PENALTY)
    penalty[np.searchsorted(at, ends)] = 0
    inside = [np.arange(a + GRID, a + n, GRID) for a, n in zip(starts[gaps > capacity].tolist(), gaps[gaps > capacity].tolist())]
    if not inside:
        return at, penalty
    more = np.concatenate(inside)
    order = np.argsort(whole := np.concatenate([at, more]), kind="stable")
    return whole[order], np.concatenate([penalty, np.full(len(more), INSIDE_PENALTY)])[order]


class Cuts:
    """The program over a stream of allowed cuts; positions are counted from the last cut given out.

    ``key[j]`` is cost(j) + pos(j). Every sequence adds to it, so as long as the least
    key of a window stays in reach, no later one is less: all cuts in its reach are settled
    at once, but for those that lie a power of two behind another cut.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        largest = (capacity - 1).bit_length() - 1
        self.powers = [1 << b for b in range(largest, LEAST_POWER.bit_length() - 2, -1)]
        self.pos, self.key, self.back = (np.zeros(1, np.int64) for _ in range(3))

    def add(self, pos: np.ndarray, penalty: np.ndarray) -> None:
        """Cuts at ``pos``, rising by at most ``capacity`` a step from the last one known."""
        capacity, start = self.capacity, len(self.pos)
        self.pos = known = np.concatenate([self.pos, pos])
        self.key, self.back = (np.concatenate([x, np.zeros(len(pos), np.int64)]) for x in (self.key, self.back))
        key, back, n = self.key, self.back, len(known)
        extra = np.concatenate([np.zeros(start, np.int64), penalty + SEQUENCE_PENALTY])
        lows = known.searchsorted(known - capacity).tolist()
        reach = known.searchsorted(known + capacity, "right").tolist()
        exact = []  # (cut, the cut a power of two before it, power)
        for power in self.powers:
            i = known.searchsorted(pos - power)
            j = np.flatnonzero(known[i] == pos - power)
            exact.append(np.stack([start + j, i[j], np.full(len(j), power)]))
        pairs = np.concatenate(exact, axis=1) if exact else np.empty((3, 0), np.int64)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        until = pairs[0].searchsorted(np.arange(n + 1)).tolist()
        pairs = pairs.T.tolist()
        j = start
        while j < n:
            # The last of equals, which stays in reach the longest.
            i = j - 1 - int(key[lows[j] : j][::-1].argmin())
            end, most = reach[i], int(key[i]) + capacity
            key[j:end] = most + extra[j:end]
            back[j:end] = i
            for at, before, power in pairs[until[j] : until[end]]:
                if (found := int(key[before]) + power) < most and found + int(extra[at]) < key[at]:
                    key[at], back[at] = found + int(extra[at]), before
            j = end

    def decided(self) -> list[int]:
        """Positions of the cuts that are on the best path to every cut from which the next sequence could begin."""
        live = int(np.searchsorted(self.pos, self.pos[-1] - self.capacity, "right"))
        # A cut leads back to an earlier one, so the latest of the paths' heads moves until all are one.
        heads = [-j for j in range(min(live, len(self.pos) - 1), len(self.pos))]
        heapq.heapify(heads)
        while True:
            j = -heapq.heappop(heads)
            while heads and heads[0] == -j:
                heapq.heappop(heads)
            if not heads:
                return self._path(j)
            heapq.heappush(heads, -int(self.back[j]))

    def ended(self) -> list[int]:
        """Positions of all cuts, if the last one known is the end."""
        return self._path(len(self.pos) - 1)

    def _path(self, root: int) -> list[int]:
        path, j = [], root
        while j:
            path.append(int(self.pos[j]))
            j = int(self.back[j])
        self.pos = self.pos[root:] - self.pos[root]
        self.key = self.key[root:] - self.key[root]
        self.back = np.maximum(self.back[root:] - root, 0)
        return path[::-1]


class Packer:
    """Packs a stream of documents into record batches of pieces: the name of the document, then what `PIECES` names."""

    def __init__(self, capacity: int, first_sequence: int, names: pa.DataType):
        self.cuts, self.capacity, self.sequence = Cuts(capacity), capacity, first_sequence
        self.ids = np.empty(0, "<u4")
        # Of the documents held: their names, where they begin (the first maybe before what is held), and the end.
        self.keys: pa.Array = pa.array([], names)
        self.bounds = np.zeros(1, np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, bounds: np.ndarray, sentences: np.ndarray) -> pa.RecordBatch:
        """Takes documents, ``ids[bounds[k]:bounds[k + 1]]`` each; gives the pieces of the sequences that are decided."""
        held = len(self.ids)
        pos, penalty = allowed_cuts(bounds[1:], sentences, self.capacity)
        self.cuts.add(pos + held, penalty)
        self.ids = np.concatenate([self.ids, ids])
        self.keys = pa.concat_arrays([self.keys, keys])
        self.bounds = np.concatenate([self.bounds, bounds[1:] + held])
        return self._give(self.cuts.decided())

    def end(self) -> pa.RecordBatch:
        return self._give(self.cuts.ended())

    def _give(self, cuts: list[int]) -> pa.RecordBatch:
        ends = np.array([0, *cuts], np.int64)
        done = int(ends[-1])
        inner = self.bounds[(self.bounds > 0) & (self.bounds < done)]
        at = np.union1d(ends, inner)
        low, length = at[:-1], np.diff(at)
        doc = np.searchsorted(self.bounds, low, "right") - 1
        sequence = np.searchsorted(ends, low, "right") - 1
        begun = self.bounds[doc]
        lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(self.ids[:done].view(np.int32)))
        columns = [low - begun, length, lists, self.bounds[np.minimum(doc + 1, len(self.bounds) - 1)] - begun, self.sequence + sequence, low - ends[sequence]]
        made = pa.RecordBatch.from_arrays(
            [self.keys.take(pa.array(doc)), *[c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]],
            ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        first = int(np.searchsorted(self.bounds, done, "right")) - 1
        # Copied, so that what was given out is not kept alive.
        self.ids, self.bounds, self.keys = self.ids[done:].copy(), self.bounds[first:] - done, pa.concat_arrays([self.keys[first:]])
        return made


def pack_batches(tokenizer: str, end_id: int, capacity: int):
    """Arrow batches of (id, text) to rows of pieces: the id, then what `PIECES` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        task = TaskContext.get()
        packer = None
        for batch in batches:
            keys = batch.column(0)
            packer = packer or Packer(capacity, (task.partitionId() if task else 0) << 40, keys.type)
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
            data = memoryview(texts.buffers()[2] or b"")
            for k, ids, bounds in encoder.blocks(texts):
                # Each document gets its end token, which moves what stands behind.
                sentences = [
                    encoder.sentence_cuts(data[offsets[k + i] : offsets[k + i + 1]], ids[a:b]) + a + i for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                ]
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                yield packer.add(keys[k : k + len(bounds) - 1], ids, bounds + np.arange(len(bounds)), np.concatenate(sentences))
        if packer:
            yield packer.end()

    return run


def digests(run: Callable) -> Callable:
    """The same rows with the CRC-32 of the ids in the place of the ids."""

    def digested(batches):
        for batch in run(batches):
            raw = batch.column("ids").values.to_numpy(zero_copy_only=True).tobytes()
            bounds = (batch.column("ids").offsets.to_numpy() * 4).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64())
            yield batch.set_column(3, "ids_crc32", crc)

    return digested


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = CAPACITY,
    digest: bool = False,
) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence.

    With ``digest``, the column ``ids`` gives way to ``ids_crc32``, taken in the
    worker, so that the ids need not travel.
    """
    run = pack_batches(tokenizer or tokens.default_tokenizer(), end_id, capacity)
    pieces = PIECES
    if digest:
        run, pieces = digests(run), PIECES.replace("ids array<int>", "ids_crc32 long")
    made = T.StructType.fromDDL(pieces)
    if key in made.names:
        raise ValueError(f"the key {key} is named like a column of the result")
    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, T.StructType([chosen.schema["id"], *made.fields])).withColumnRenamed("id", key)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, digest=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
