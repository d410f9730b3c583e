"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets confirm them.

1. Each text becomes the set of its 5-word shingles (64-bit hashes). Texts with
   equal sets form one node, numbered by a 64-bit hash of the set. A signature of
   `HASHES` minima is cut into bands; `banding` chooses the numbers for the
   recall asked for at the threshold, and the sharpest curve beyond.
2. Documents of one node are counted and go on as one row. Band hashes are shuffled. A
   bucket never gathers its nodes: each node is linked to the least node of each of its
   buckets, so a bucket of a million nodes gives a million rows.
3. The components of these links are the candidate groups: whatever shares a
   bucket, directly or through others, is in one group. The texts of grouped nodes
   (one per node) are read again and become sets.
4. Groups are dealt into blocks of at most `BLOCK_NODES` nodes and
   `BLOCK_SHINGLES` shingles. Each pair of blocks of a group is one task's work:
   all its pairs are compared by exact counts of common shingles, as products of
   matrices. It gives back per node the number of links and one edge to its local
   component, never the pairs. A group of n nodes costs n / BLOCK_NODES copies of
   itself in the shuffle; that is what an exact number of links takes.
5. The components of the confirmed links are the classes.

Words: A-Z in lower case, then runs of digits, a-z and characters from U+0080. A
text of one to four words is a single shingle of all of them. With 64-bit node
numbers, about n ** 2 / 2 ** 65 pairs of n different sets are taken for equal. Documents
are told apart by 128 bits of their key and text.

What joins the table of documents is a written table itself, so adaptive execution can
split a hot key (a node with a third of all documents).

Defined results: a text without words (null, empty, symbols only) is in a class
of its own and has no links; rows equal in key and text count as one document
in `drop_near_copies` and are answered one by one in `classes`; null keys and
null other columns are carried; empty table in, empty table out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import number, words_of
from papyrion.llm.graph import connected_components
from papyrion.session import stage

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.995
HASHES = 256
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 20
_COLUMNS = 4096  # of one matrix product


@lru_cache
def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that still give ``recall`` at ``threshold``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("too few hashes for this recall")


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _WordHash()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of 64-bit hashes of the runs of ``width`` words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache
def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_250_101)
    odd = random.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, random.integers(0, 2**32, hashes, dtype=np.uint32)


def band_hashes(found: np.ndarray, bands: int, rows: int) -> list[int]:
    factor, shift = _factors(bands * rows)
    folded = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(folded), 2048):
        least = np.minimum(least, (folded[k : k + 2048, None] * factor + shift).min(axis=0))
    values = least.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = (out ^ values[:, r]) * _MIX[r % len(_MIX)]
        out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


_SIGNATURES = "r long, s long, key long, node long, n int, bands array<long>"


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, count, made = [], [], []
            for value in batch.column(3):
                found = shingles(value.as_py(), width)
                node.append(node_of(found) if len(found) else None)
                count.append(len(found))
                made.append(band_hashes(found, bands, rows) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(node, pa.int64()), pa.array(count, pa.int32()), pa.array(made, pa.list_(pa.int64()))],
                ["r", "s", "key", "node", "n", "bands"],
            )

    return run


def _sets(width: int):
    """The sets of nodes; rows that are equal in key and text are the same node, which a task gives once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            found = pa.array([shingles(v.as_py(), width).tobytes() for v in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["node", "component", "blocks", "shingles"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``left`` shares with each of ``right``."""
    sides = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    rows, columns = [], []
    for flat, sets in zip(sides, (left, right)):
        at = np.searchsorted(shared, flat)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == flat[hit]
        rows.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit])
        columns.append(at[hit])
    order = [np.argsort(c, kind="stable") for c in columns]
    rows, columns = [r[o] for r, o in zip(rows, order)], [c[o] for c, o in zip(columns, order)]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(shared), _COLUMNS):
        dense = []
        for r, c, sets in zip(rows, columns, (left, right)):
            a, b = np.searchsorted(c, [k, k + _COLUMNS])
            m = np.zeros((len(sets), min(_COLUMNS, len(shared) - k)), np.float32)
            m[r[a:b], c[a:b] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _links(nodes: list[np.ndarray], sets: list[list[np.ndarray]], threshold: float) -> pa.Table:
    """Links within one block, or between two; per node their number and the least node of its local component."""
    left, right = sets[0], sets[-1]
    common = _common(left, right)
    sizes = [np.array([len(s) for s in x], np.float64) for x in (left, right)]
    linked = common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-6
    if len(sets) == 1:
        np.fill_diagonal(linked, False)
        names, counts = nodes[0], linked.sum(axis=1)
        i, j = np.nonzero(linked)
    else:
        names, counts = np.concatenate(nodes), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
        i, j = np.nonzero(linked)
        j = j + len(left)
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
    root = names.copy()
    while len(i):  # the least neighbour's root, until nothing moves
        new = root.copy()
        np.minimum.at(new, i, root[j])
        if (new == root).all():
            break
        root = new
    some = counts > 0
    return pa.table({"node": names[some], "links": counts[some].astype(np.int64), "root": root[some]})


def _unpack(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Node numbers and sets, each node once."""
    seen: dict[int, np.ndarray] = {}
    for node, raw in zip(table.column("node").to_pylist(), table.column("shingles").to_pylist()):
        seen.setdefault(node, np.frombuffer(raw, np.uint64))
    return np.array(list(seen), np.int64), list(seen.values())


def _within(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        nodes, sets = _unpack(table)
        return _links([nodes], [sets], threshold)

    return run


def _pack_block(table: pa.Table) -> pa.Table:
    nodes, sets = _unpack(table)
    lengths = np.array([len(s) for s in sets], np.int64)
    first = table.slice(0, 1)
    return pa.table(
        {
            "component": first.column("component"),
            "blocks": first.column("blocks"),
            "block": first.column("block"),
            "nodes": [nodes.tobytes()],
            "lengths": [lengths.tobytes()],
            "flat": [np.concatenate(sets).tobytes()],
        }
    )


_NO_LINKS = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})


def _between(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        nodes, sets = [], []
        rows = table.sort_by("block").to_pylist()  # one block, or two
        if rows[0]["a"] != rows[0]["b"] and len(rows) == 1:  # the other block is empty; links within this one are counted at (a, a)
            return _NO_LINKS
        for row in rows:
            lengths, flat = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["flat"], np.uint64)
            nodes.append(np.frombuffer(row["nodes"], np.int64))
            sets.append(np.split(flat, np.cumsum(lengths)[:-1]))
        return _links(nodes, sets, threshold)

    return run


_LINKS = "node long, links long, root long"


def _confirmed(grouped: DataFrame, threshold: float) -> DataFrame:
    """``grouped``: (node, component, blocks, shingles). Gives (node, links, component of confirmed links)."""
    small = grouped.where("blocks = 1").groupBy("component").applyInArrow(_within(threshold), _LINKS)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    packed = (
        grouped.where("blocks > 1")
        .withColumn("block", block)
        .groupBy("component", "block")
        .applyInArrow(_pack_block, "component long, blocks int, block int, nodes binary, lengths binary, flat binary")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = packed.select("*", other).select("*", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    large = stage(paired.groupBy("component", "a", "b").applyInArrow(_between(threshold), _LINKS), "links-between-blocks")
    # Only links between blocks still have to be put together.
    whole = connected_components(large.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = large.groupBy("node").agg(F.sum("links").alias("links")).join(whole, "node")
    return small.withColumnRenamed("root", "component").unionByName(counted)


def _row_hashes(key: str, text: str) -> list[Column]:
    """128 bits of a document's key and text."""
    return [F.xxhash64(f"`{key}`", f"`{text}`"), F.xxhash64(F.lit(1), f"`{text}`", f"`{key}`")]


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH
) -> DataFrame:
    """One row per document: ``r``, ``s`` (hashes of key and text), ``key``, ``class_node``, ``n_copies``, ``n_links``.

    ``n_copies`` counts the documents with the same n-gram set, itself included;
    ``n_links`` the different sets at ``threshold`` or above. ``class_node`` names
    the class; it is null for a text without words.
    """
    bands, rows = banding(threshold, recall)
    r, s = _row_hashes(key, text)
    texts = docs.select(r.alias("r"), s.alias("s"), number(docs, key).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = stage(texts.mapInArrow(_sign(width, bands, rows), _SIGNATURES), "signatures")
    # One document speaks for each node.
    spoken = F.min(F.struct("r", "s", "n", "bands")).alias("of")
    nodes = stage(
        signed.where("node IS NOT NULL").groupBy("node").agg(spoken, F.count("*").alias("n_copies")).select("node", "n_copies", "of.*"), "nodes"
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = stage(
        banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader"),
        "shared-bands",
    )
    candidates = banded.join(shared, "band").where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    members = stage(connected_components(candidates), "candidate-groups")
    chosen = nodes.join(members, "node").select("r", "s", "node", "component", "n")
    sizes = chosen.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    chosen = stage(chosen.join(sizes, "component").select("r", "s", "node", "component", "blocks"), "chosen-texts")
    # Dealt by hash at every size, so that the plan does not turn with the length of the list; hot rows split, as the list is a written table.
    fetched = texts.select("r", "s", "text").join(chosen.hint("merge"), ["r", "s"]).select("node", "component", "blocks", "text")
    grouped = stage(fetched.mapInArrow(_sets(width), "node long, component long, blocks int, shingles binary"), "shingle-sets")
    if grouped.count() > chosen.count():  # the same row came to several tasks
        grouped = grouped.dropDuplicates(["node"])
    links = stage(_confirmed(grouped, threshold), "confirmed-links")
    known = nodes.join(links, "node", "left").select(
        "node", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("class_node")
    )
    known = stage(known, "known-nodes")
    found = signed.where("node IS NOT NULL").select("r", "s", "key", "node").join(known, "node")
    alone = signed.where("node IS NULL").select("r", "s", "key", F.col("node").alias("class_node"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return found.select("r", "s", "key", "class_node", "n_copies", "n_links").unionByName(alone)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that with the least key (nulls last), then text hash."""
    found = classes(docs, key, text, **options)
    alone = found.where("class_node IS NULL").select("r", "s").distinct()
    first = found.where("class_node IS NOT NULL").groupBy("class_node").agg(
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "r", "s")).alias("first")
    )
    kept = stage(alone.unionByName(first.select("first.r", "first.s")), "kept-rows")
    r, s = _row_hashes(key, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), r.alias("r"), s.alias("s"))
    return rows.join(kept, ["r", "s"], "left_semi").dropDuplicates(["r", "s"]).select("row.*")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = stage(classes(docs), "classes")
    grouped = found.where("class_node IS NOT NULL")
    named = stage(grouped.groupBy("class_node").agg(F.min("key").alias("class_id")), "named-classes")
    whole = grouped.join(named, "class_node").unionByName(found.where("class_node IS NULL").withColumn("class_id", F.col("key")))
    return whole.select(F.col("key").alias("doc_id"), "class_id", "n_links", "n_copies")


#: DuckDB SQL of the same rows, from all pairs that share a shingle.
OP1_SQL = r"""
WITH RECURSIVE word AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT d, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM word WHERE len(w) > 0),
doc AS (SELECT d, doc_id, s, md5(array_to_string(s, ',')) AS node FROM grams),
node AS MATERIALIZED (SELECT node, any_value(s) AS s, min(doc_id) AS least, count(*) AS n_copies FROM doc GROUP BY node),
inv AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS g FROM node),
link AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.node AS x, b.node AS y, count(*) AS c, min(a.n) AS nx, min(b.n) AS ny FROM inv a JOIN inv b ON a.g = b.g AND a.node <> b.node GROUP BY a.node, b.node)
  WHERE c >= 0.8 * (nx + ny - c) - 1e-6),
reach AS (SELECT node AS x, node AS y FROM node UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT x AS node, min(least) AS class_id FROM reach JOIN node ON node.node = reach.y GROUP BY x),
deg AS (SELECT x AS node, count(*) AS n_links FROM link GROUP BY x)
SELECT word.doc_id, coalesce(class_id, word.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM word LEFT JOIN doc ON doc.d = word.d LEFT JOIN node ON node.node = doc.node LEFT JOIN class ON class.node = doc.node LEFT JOIN deg ON deg.node = doc.node
"""
