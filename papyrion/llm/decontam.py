"""Benchmark decontamination with a positional inverted index of the training texts.

The index is a Parquet table of segments in the shared folder. A segment covers
a run of documents of about `SEGMENT_TOKENS` words and is one row: the sorted
terms, where each term's postings start, and the postings, which are word
positions in the segment sorted by term and then position. Documents are laid
end to end with a gap, so that no phrase runs from one into the next. Segments
are made where the texts are read, so postings are never shuffled, and a term
that stands in every text is spread over all segments.

A search takes phrases (windows of the benchmark) in blocks of bounded size to
every segment. A phrase that lacks one of its terms in a segment is out. For the
others the shortest posting list, which is that of the rarest term, is shifted
by the term's offset to give candidate starts; then the lists of the other terms,
from rare to frequent, are intersected with the candidates, each shifted by its
own offset. With ``slop`` 0 that gives the exact phrases; with more, there must be a start
from which each term is at most that many words off its place, which gives proximity
matches: the rarest term's positions are tried with each shift.

A segment has a number of its own (that of its task, then its place in the task), so what
several blocks find in one document is put together by segment and place, whatever the
document's id and words are. Windows are tried in slices of bounded numbers of candidates.

Words: A-Z in lower case, then runs of the digits, a-z and all characters from
U+0080. A window is 10 consecutive words; a shorter text is one window.

Defined results: a null or empty text has no words, no hits, and is not
contaminated; benchmark rows without words match nothing; a null item id is
searched but has no name to list; repeated documents are answered one by one; an
empty benchmark leaves all clean; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.llm.common import words_of
from papyrion.session import stage, staging_path

WINDOW = 10
#: Words of a segment, about; one long document may exceed it.
SEGMENT_TOKENS = 1 << 18
#: Segments of one Parquet row group: a task that writes or reads the index has no more of them in memory, however long its file is.
ROW_GROUP = 4
#: Places a word may be off in a proximity match.
SLOP = 2
#: Benchmark text that one pass over the index takes along.
BLOCK_BYTES = 8 << 20
#: Empty positions between documents: more than a window and its slop.
GAP = 64
#: Windows, and candidate starts of them, that are tried at once.
SLICE_WINDOWS = 1 << 14
SLICE_STARTS = 1 << 20

SEGMENTS = "segment long, docs array<string>, starts array<int>, sizes array<int>, terms binary, bounds array<int>, postings array<int>"


def _segment(number: int, keys: list, texts: list[list[bytes]]) -> dict:
    ids: dict[bytes, int] = {}
    sizes = [len(w) for w in texts]
    starts = np.cumsum([0] + [n + GAP for n in sizes[:-1]]) if sizes else np.empty(0, int)
    found = np.fromiter((ids.setdefault(w, len(ids)) for words in texts for w in words), np.int32, sum(sizes))
    position = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes)] or [np.empty(0, int)])
    names = list(ids)
    rank = np.empty(len(names), np.int32)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank[order] = np.arange(len(names))
    term = rank[found]
    by_term = np.argsort(term, kind="stable")  # positions rise already
    return {
        "segment": number,
        "docs": keys,
        "starts": starts.astype(np.int32),
        "sizes": np.array(sizes, np.int32),
        "terms": b" ".join(names[i] for i in order),
        "bounds": np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int32),
        "postings": position[by_term].astype(np.int32),
    }


_ARROW = pa.schema(
    [
        ("segment", pa.int64()),
        ("docs", pa.list_(pa.string())),
        ("starts", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("bounds", pa.list_(pa.int32())),
        ("postings", pa.list_(pa.int32())),
    ]
)


def _index(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                texts.append(words := words_of(text.as_py()))
                held += len(words) + 1
                if held >= size:
                    yield pa.RecordBatch.from_pylist([_segment(number, keys, texts)], _ARROW)
                    keys, texts, held = [], [], 0
                    number += 1
        if keys:
            yield pa.RecordBatch.from_pylist([_segment(number, keys, texts)], _ARROW)

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT_TOKENS) -> DataFrame:
    """The positional index of ``docs``, written to the shared folder (with keys as strings)."""
    chosen = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string"))
    path = staging_path(docs.sparkSession, "positional-index")
    # By default a row group is checked after 100 rows, and read 4096 rows at once, which are gigabytes of segments.
    writer = chosen.mapInArrow(_index(segment), SEGMENTS).write.option("compression", "zstd")
    writer.option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    index = docs.sparkSession.read.schema(SEGMENTS).parquet(path)
    return index.withColumn("docs", F.col("docs").cast(T.ArrayType(docs.schema[key].dataType)))


class Phrases:
    """Windows of a block of items as arrays of term numbers, one array for each window length.

    The items that hold window k of length n are ``owners[n][bounds[n][k]:bounds[n][k + 1]]``.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.items = [key for key, _ in items]
        self.terms: dict[bytes, int] = {}
        made: dict[int, list[np.ndarray]] = {}
        owned: dict[int, list[np.ndarray]] = {}
        for i, (_, text) in enumerate(items):
            words = np.array([self.terms.setdefault(w, len(self.terms)) for w in words_of(text)], np.int32)
            if n := min(window, len(words)):
                made.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(words, n))
                owned.setdefault(n, []).append(np.full(len(words) - n + 1, i))
        self.windows: dict[int, np.ndarray] = {}
        self.owners: dict[int, np.ndarray] = {}
        self.bounds: dict[int, np.ndarray] = {}
        for n, found in made.items():
            self.windows[n], which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) << 32 | np.concatenate(owned[n]))
            self.owners[n] = (pairs & 0xFFFFFFFF).astype(np.int32)
            self.bounds[n] = np.searchsorted(pairs >> 32, np.arange(len(self.windows[n]) + 1))


def _matches(windows: np.ndarray, lists: np.ndarray, base: np.ndarray, ends: np.ndarray, keyed: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, starts) of the matches, slice by slice. ``lists`` maps term numbers to rows of the segment's table, or -1.

    ``keyed`` holds all postings as term << 32 | position, in order.
    """
    shifts = np.arange(-slop, slop + 1)
    for low in range(0, len(windows), SLICE_WINDOWS):
        row = lists[windows[low : low + SLICE_WINDOWS]]
        alive = np.flatnonzero((row >= 0).all(axis=1))
        row = row[alive]
        order = np.argsort((ends - base)[row], axis=1, kind="stable")
        first = row[np.arange(len(row)), order[:, 0]]
        starts = np.cumsum((ends - base)[first]) * len(shifts)
        at = 0
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(starts, (starts[at - 1] if at else 0) + SLICE_STARTS, "right")))
            which, start = _tried(row[at:end], order[at:end], first[at:end], base, ends, keyed, shifts)
            yield low + alive[at:end][which], start
            at = end


def _tried(row: np.ndarray, order: np.ndarray, first: np.ndarray, base: np.ndarray, ends: np.ndarray, keyed: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of the matches of some windows, from the places of their rarest terms, ``first``."""
    slop = int(shifts[-1])
    counts = (ends - base)[first]
    which = np.repeat(np.arange(len(row)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(base[first], counts)
    start = (keyed[at] & 0xFFFFFFFF) - order[which, 0]
    if slop:
        which, start = np.repeat(which, len(shifts)), (start[:, None] + shifts).ravel()
    for k in range(1, row.shape[1]):
        offset = order[which, k]
        term, want = row[which, offset].astype(np.int64) << 32, start + offset
        # The first posting at or after the earliest place allowed must not lie beyond the last.
        i = np.searchsorted(keyed, term + np.maximum(want - slop, 0))
        ok = (i < len(keyed)) & (keyed[np.minimum(i, len(keyed) - 1)] <= term + want + slop)
        which, start = which[ok], start[ok]
    return which, start


def search_segment(segment: dict, phrases: Phrases, slop: int) -> list[tuple]:
    """(doc, place in the segment, words, hit intervals, items, items nearby) for each document."""
    starts, sizes = np.asarray(segment["starts"], np.int64), np.asarray(segment["sizes"], np.int64)
    bounds, postings = np.asarray(segment["bounds"], np.int64), np.asarray(segment["postings"], np.int64)
    names = segment["terms"].split(b" ") if segment["terms"] else []
    base, ends = bounds[:-1], bounds[1:]
    keyed = (np.repeat(np.arange(len(names), dtype=np.int64), ends - base) << 32) + postings
    lists = np.full(max(1, len(phrases.terms)), -1, np.int64)
    for r, name in enumerate(names):
        if (t := phrases.terms.get(name)) is not None:
            lists[t] = r
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set] = {}
    near: dict[int, set] = {}
    for n, windows in phrases.windows.items():
        owners, bounds_of = phrases.owners[n], phrases.bounds[n]
        for allowed, into in ((0, items), (slop, near)) if slop else ((0, items),):
            for which, start in _matches(windows, lists, base, ends, keyed, allowed):
                # A shifted start may lie before its document.
                doc = np.searchsorted(starts, np.maximum(start + allowed, 0), "right") - 1
                for w, s, d in zip(which.tolist(), start.tolist(), doc.tolist()):
                    into.setdefault(d, set()).update(owners[bounds_of[w] : bounds_of[w + 1]].tolist())
                    if not allowed:
                        low = s - int(starts[d])
                        spans.setdefault(d, []).append((low, low + n))
    out = []
    for d, (key, size) in enumerate(zip(segment["docs"], sizes.tolist())):
        merged: list[list[int]] = []
        for a, b in sorted(spans.get(d, ())):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        # An item may stand on several rows; each name is listed once.
        name = lambda found: list(dict.fromkeys(x for i in sorted(found) if (x := phrases.items[i]) is not None))
        out.append((key, d, size, merged, name(items.get(d, ())), name(near.get(d, ()))))
    return out


MATCHES = "doc_id string, segment long, place int, n_words long, hits array<array<int>>, items array<string>, near_items array<string>"
_ARROW_MATCHES = pa.schema(
    [
        ("doc_id", pa.string()),
        ("segment", pa.int64()),
        ("place", pa.int32()),
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.list_(pa.int32()))),
        ("items", pa.list_(pa.string())),
        ("near_items", pa.list_(pa.string())),
    ]
)


def _search(phrases, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                lists = {c: row[c].values.to_numpy() for c in ("starts", "sizes", "bounds", "postings")}
                segment = lists | {"docs": row["docs"].values.to_pylist(), "terms": row["terms"].as_py()}
                found = search_segment(segment, phrases.value, slop)
                number = row["segment"].as_py()
                made = [(d, number, p, n, h, [*map(str, i)], [*map(str, m)]) for d, p, n, h, i, m in found]
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW_MATCHES.names, x)) for x in made], _ARROW_MATCHES)

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple]]:
    """The rows of the benchmark in blocks of bounded size; the driver holds one block."""
    block, held = [], 0
    rows = benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`").cast("string"))
    for key, value in rows.toLocalIterator():
        block.append((key, value))
        held += len(value or "") + 16
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(
    index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", slop: int = SLOP, block: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document of the index: its words, hit intervals, and items with exact or proximity matches."""
    spark, kind = index.sparkSession, index.schema["docs"].dataType.elementType
    index = index.withColumn("docs", F.col("docs").cast("array<string>"))
    found = []
    for rows in _blocks(benchmark, item, text, block):
        found.append(index.mapInArrow(_search(spark.sparkContext.broadcast(Phrases(rows)), slop), MATCHES))
    if not found:
        found = [index.mapInArrow(_search(spark.sparkContext.broadcast(Phrases([])), slop), MATCHES)]
    if len(found) == 1:
        return found[0].drop("segment", "place").withColumn("doc_id", F.col("doc_id").cast(kind))
    parts = stage(found[0], "matches")
    for more in found[1:]:
        parts = parts.unionByName(stage(more, "matches"))
    # Each block answers for each document once; only their findings are put together.
    joined = parts.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    merged = F.aggregate(
        F.array_sort("hits"),
        F.array().cast("array<array<int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.get(F.element_at(done, -1), F.lit(1)) >= F.get(x, F.lit(0))),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.array(F.get(F.element_at(done, -1), F.lit(0)), F.greatest(F.get(F.element_at(done, -1), F.lit(1)), F.get(x, F.lit(1))))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    merged = F.when(F.size("hits") > 0, merged).otherwise(F.col("hits"))
    return joined.withColumns({"hits": merged, "doc_id": F.col("doc_id").cast(kind)}).drop("segment", "place")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document with words, hit words, and the items found in it."""
    return search(build_index(docs, key, text), benchmark, **options)


def n_hit():
    """Words inside the merged intervals ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (F.get(x, F.lit(1)) - F.get(x, F.lit(0))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark; columns and repeated rows stay.

    The decision is made by 128 bits of the text, so it does not depend on ids being unique.
    """
    name = F.concat_ws("_", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    texts = docs.select(F.col(f"`{text}`").alias("text")).select(name.alias("name"), "text")
    found = contamination(texts, benchmark, "name", "text", slop=0)
    # Written, so that its size is known: a short list is sent to all tasks, a long one is shuffled.
    bad = stage(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("name")).distinct(), "contaminated")
    # All columns travel as one, so no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.select("row", name.alias("name")).join(bad, "name", "left_anti").select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_compact("items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


#: DuckDB SQL of the same rows.
OP9_SQL = r"""
WITH word AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item, row_number() OVER () AS b,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
owned AS (
  SELECT DISTINCT item, n, w[i:i + n - 1] AS win
  FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
win AS MATERIALIZED (SELECT row_number() OVER () AS q, win, n FROM (SELECT DISTINCT win, n FROM owned)),
place AS MATERIALIZED (SELECT d, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM word),
-- The rarest term of each window gives the places to look at.
part AS (SELECT q, unnest(win) AS term, generate_subscripts(win, 1) AS k FROM win),
freq AS (SELECT term, count(*) AS f FROM place SEMI JOIN (SELECT DISTINCT term FROM part) t USING (term) GROUP BY term),
rare AS (SELECT q, arg_min(term, (coalesce(f, 0), k)) AS term, arg_min(k, (coalesce(f, 0), k)) AS k FROM part LEFT JOIN freq USING (term) GROUP BY q),
near AS (
  SELECT DISTINCT q, d, s FROM (SELECT q, d, unnest(range(p - k - 2, p - k + 3)) AS s FROM rare JOIN place USING (term))),
tried AS (
  SELECT near.q, near.d, s + 1 AS s, n,
         s >= 0 AND w[s + 1:s + n] = win AS exact,
         len(list_filter(range(1, n + 1), lambda k: list_contains(w[greatest(1, s + k - 2):greatest(0, s + k + 2)], win[k]))) = n AS close
  FROM near JOIN win ON win.q = near.q JOIN word ON word.d = near.d),
found AS (
  SELECT d, item, bool_or(exact) AS exact FROM (SELECT d, q, bool_or(exact) AS exact FROM tried WHERE exact OR close GROUP BY d, q) t
  JOIN win USING (q) JOIN owned ON owned.win = win.win GROUP BY d, item),
items AS (
  SELECT d, count(item) FILTER (exact) AS n_items, string_agg(item, ',' ORDER BY item) FILTER (exact) AS names, count(item) AS n_near FROM found GROUP BY d),
hit AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(s, s + n)) AS p FROM tried WHERE exact) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM word LEFT JOIN hit ON hit.d = word.d LEFT JOIN items ON items.d = word.d
"""
