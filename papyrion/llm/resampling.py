"""Resampling a corpus towards a target by importance weights of hashed n-grams.

1. Both corpora are counted by bucket: a feature is a run of words, its bucket the CRC-32 of its
   UTF-8 bytes modulo the number of buckets. Each task hands on one array of counts, so what is
   shuffled and what comes to the driver is bounded by the number of buckets.
2. A bucket's gain is the logarithm of its share in the target over that in the corpus, in
   thousandths and rounded down. The gains are one array; a document's weight is the mean of the
   array at its features, rounded down. The score adds noise from a hash of the id, so that
   the rows with the highest scores are a draw without replacement in proportion to the weights.
   The scores are written.
3. The cutoff: a quantile sketch of the scores gives a bracket around the place wanted. Exact counts
   of the scores above it and in it say whether the cutoff lies inside; if not, the bracket is made
   wider, in the end to all scores. Only what lies in the bracket is sorted, and the cutoff (score and
   id) is read off at its place.
4. The rows from the cutoff on are put in order by ranges and numbered; the others have no rank.

Words: A-Z in lower case, then runs of digits, a-z and characters from U+0080.

Defined results: a null or empty text has no features and the weight 0; a null id is hashed as the
empty text and comes last among equal scores; rows equal in score and id are ranked in any order, each
with a rank of its own; an empty target gives gains of the corpus against nothing; an empty
corpus gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.llm.common import words_of
from papyrion.session import stage

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
#: Documents with fewer words are scored, but not drawn.
LEAST_WORDS = 20
PERCENT = 10
#: One part in this many is the error of the quantile sketch.
SKETCH_ACCURACY = 10_000
#: Buckets of words that a worker remembers before it starts afresh.
KNOWN_WORDS = 1 << 18


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[feature] = bucket = crc32(feature) % self.buckets
        return bucket


def _features(text: str | None, known: _Buckets, ngram: int) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, and its number of words."""
    words = words_of(text)
    found = list(map(known.__getitem__, words))
    for n in range(2, ngram + 1):
        found += [known[b" ".join(words[k : k + n])] for k in range(len(words) - n + 1)]
    return np.array(found, np.int64), len(words)


def bucket_counts(texts: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all rows fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(_features(value.as_py(), known, ngram)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    summed = texts.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, 1000 times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    s_all, t_all, m = float(corpus.sum()), float(target.sum()), len(corpus)
    made = [math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())]
    return np.array(made, np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row."""
    fields = T.StructType.fromDDL("n_words long, n_features long, weight long, score long")
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(len(sent.value))
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                found, n_words = _features(value.as_py(), known, ngram)
                weight = int(sent.value[found].sum()) // len(found) if len(found) else 0
                rows.append((n_words, len(found), weight, weight + noise(name or "", seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["__key", *fields.names])

    named = F.col(f"`{key}`")
    chosen = docs.select(named.alias("__key"), named.cast("string").alias("name"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, T.StructType([chosen.schema["__key"], *fields.fields])).withColumnRenamed("__key", key)


def _order(key: str, score: str = "score"):
    return [F.col(score).desc(), F.col(f"`{key}`").asc_nulls_last()]


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` by falling score, with ``rank`` from 1: dealt by ranges, so that no task holds more than its share."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *_order(key)).sortWithinPartitions(*_order(key))
    held = stage(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    # One row for each task.
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__base"))
    placed = held.withColumn("__part", part).join(F.broadcast(bases), "__part")
    rank = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("rank", rank).drop("__part", "__base", "__at")


def bracket(there: DataFrame, wanted: int, total: int, score: str = "score", accuracy: int = SKETCH_ACCURACY) -> tuple[int, int, int]:
    """(low, high, rows above high): scores between which the ``wanted``-th highest of ``total`` lies, as exact counts confirm."""
    slack = 2.0 / accuracy
    while True:
        at = 1 - wanted / total
        ends = [max(0.0, at - slack), min(1.0, at + slack)]
        low, high = there.agg(F.percentile_approx(score, ends, accuracy).alias("q")).first()["q"]
        if slack >= 1:
            low, high = there.agg(F.min(score), F.max(score)).first()
        above, inside = there.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score).between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        slack *= 4


def cutoff(there: DataFrame, wanted: int, total: int, key: str = "doc_id", accuracy: int = SKETCH_ACCURACY) -> tuple[int, object]:
    """(score, key) of the ``wanted``-th row by falling score, then rising key."""
    low, high, above = bracket(there, wanted, total, accuracy=accuracy)
    inside = _numbered(there.where(F.col("score").between(low, high)).select(key, "score"), key, "bracket")
    last = inside.where(F.col("rank") == wanted - above).first()
    return last["score"], last[key]


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row of ``docs``; rows that are not drawn have no rank."""
    gain = gains(bucket_counts(docs, text, ngram, buckets), bucket_counts(target, text, ngram, buckets))
    scored = stage(scores(docs, gain, key, text, ngram, seed), "scores")
    enough = F.col("n_words") >= least_words
    there = scored.where(enough)
    total = there.count()
    wanted = percent * total // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    score, last = cutoff(there, wanted, total, key, accuracy)
    name = F.col(f"`{key}`")
    # At the same score, ids up to the last one; null ids come behind all others.
    upto = F.lit(True) if last is None else name.isNotNull() & (name <= F.lit(last))
    drawn = enough & ((F.col("score") > score) | ((F.col("score") == score) & upto))
    ranked = _numbered(scored.where(drawn), key, "drawn")
    # Rows that repeat the last one's score and id may be more than there is room for.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of the same rows; the CRC-32 of each different word is taken bit by bit.
OP11_SQL = r"""
WITH word AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f
  FROM benchmark),
place AS MATERIALIZED (SELECT d, unnest(w) AS f FROM word),
byte AS (
  SELECT f, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM place UNION ALL SELECT f FROM goal))),
step AS (
  SELECT f, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS c
  FROM byte),
bucket AS MATERIALIZED (SELECT f, xor(c, 4294967295::BIGINT) % 10000 AS k FROM step),
s AS (SELECT k, count(*) AS s FROM place JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM goal JOIN bucket USING (f) GROUP BY k),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range(0, 10000)) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
mean AS (
  SELECT d, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM place JOIN bucket USING (f) JOIN gain USING (k) GROUP BY d),
scored AS (
  SELECT doc_id, word.d, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM word LEFT JOIN mean ON mean.d = word.d),
ranked AS (SELECT d, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked ON ranked.d = scored.d
"""
