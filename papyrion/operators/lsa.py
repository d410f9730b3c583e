"""An embedder that is fitted on the texts: TF-IDF on hashed words, and the main axes of it by a randomised SVD.

A word is a bucket: the CRC-32 of its UTF-8 bytes modulo `TERMS`. A text is a sparse row of weights, (1 + ln count) times
ln((1 + texts) / (1 + texts with the bucket)) + 1, of length 1. The rows are written once. Then each pass takes a few directions
Q and gives A'(AQ): tasks keep their rows, and hand on one sum for each bucket that they have; the sums, `TERMS` times the number of
directions at most, are made orthogonal on the driver and go out again. After `PASSES` of these, the main axes follow from the
small matrix Q'A'AQ. They come by falling weight, each with its largest entry positive, so a fit on the same texts gives the same axes.

The embedder is a callable like any other: it can split by meaning, make vectors for an index, and answer questions.

Defined results: a null or empty text, or one of unknown words alone, is the zero vector; fewer texts than axes give
axes of zeros behind the last; no texts at all, zeros only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.operators.order import in_slices
from papyrion.session import stage

TERMS = 1 << 14
DIMS = 64
#: Directions beyond those wanted, which make the wanted ones exact sooner.
MORE = 16
PASSES = 4
_WORD = re.compile(r"\w+")
#: Texts that are cut into words before they leave a task.
_ROWS = 512


class _Hashed(dict):
    """Word to bucket, found once for each word."""

    def __init__(self, terms: int):
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = crc32(word.encode()) % self.terms
        return found


#: One table for each number of buckets in a worker.
_hashed = lru_cache(_Hashed)


def _buckets(text: str | None, terms: int) -> tuple[list[int], list[int]]:
    """The different buckets of a text's words, rising, and how often each comes."""
    counts = sorted(Counter(map(_hashed(terms).__getitem__, _WORD.findall((text or "").lower()))).items())
    return [b for b, _ in counts], [n for _, n in counts]


@dataclass(frozen=True, eq=False)
class FittedEmbedder:
    """Texts to vectors on fitted axes, of length 1 at most: texts that use words alike are near each other."""

    idf: np.ndarray
    axes: np.ndarray
    weights: np.ndarray

    @property
    def name(self) -> str:
        """Differs between fits, so that a cache does not serve the chunks of one to another."""
        return f"FittedEmbedder-{hashlib.md5(self.idf.tobytes() + self.axes.tobytes()).hexdigest()}"

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, counts = _buckets(text, len(self.idf))
        weights = (1 + np.log(np.array(counts, np.float64))) * self.idf[at] if at else np.empty(0)
        return np.array(at, np.int64), weights / max(np.sqrt((weights * weights).sum()), 1e-300)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]))
        for k, text in enumerate(texts):
            at, weights = self.row(text)
            if len(at):
                out[k] = weights @ self.axes[at]
        return out


def _turned():
    """Counts of words (at, counts) to (bucket, A'(AQ) of the rows of the task)."""

    def run(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        q, idf = sent.value
        total, there = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            at, counts = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)) for c in (0, 1))
            ends = np.cumsum(sizes)
            weights = (1 + np.log(counts)) * idf[at]
            # A row has a bucket once, so its part of the sums is added to different places.
            for low, high in zip((ends - sizes).tolist(), ends.tolist()):
                if low < high:
                    own, w = at[low:high], weights[low:high]
                    w = w / max(np.sqrt((w * w).sum()), 1e-300)
                    total[own] += w[:, None] * (w @ q[own])
            there[at] = True
        some = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["bucket", "s"])

    return run


def fit_embedder(texts: DataFrame, text: str = "text", dims: int = DIMS, terms: int = TERMS, passes: int = PASSES, seed: int = 1) -> FittedEmbedder:
    """An embedder fitted on all rows of ``texts``."""
    spark = texts.sparkSession

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, _ROWS):
            made = [_buckets(value.as_py(), terms) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64())) for c in zip(*made)], ["at", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(terms, np.int64), 0
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
            n += batch.num_rows
        some = np.flatnonzero(seen)
        # Under -1, the number of texts.
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *seen[some].tolist()], pa.int64())], ["bucket", "n"])

    # Texts are cut into words once.
    held = stage(texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(rows, "at array<long>, counts array<long>"), "counted-words")
    found = dict(map(tuple, held.select("at").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()))
    n = found.pop(-1, 0)
    df = np.zeros(terms)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    many = min(terms, dims + MORE)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, many)))[0]
    for k in range(passes):
        sent, run = spark.sparkContext.broadcast((q, idf)), _turned()
        parts = held.mapInArrow(lambda b, sent=sent: run(b, sent), "bucket long, s array<double>")
        y = np.zeros((terms, many))
        for bucket, *s in parts.groupBy("bucket").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(many)]).collect():
            y[bucket] = s
        if k + 1 < passes:
            q = np.linalg.qr(y)[0]
    small = q.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[:dims]
    weights = np.maximum(values[order], 0)
    axes = (q @ vectors[:, order]) * (weights > 1e-9 * max(1e-300, weights.max(initial=0)))
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    return FittedEmbedder(idf, axes * np.where(signs == 0, 1, signs), np.sqrt(weights))
