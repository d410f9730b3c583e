"""Pages to chunks: by separators and size, or by meaning.

Both work on one page at a time, so there is no shuffle: Arrow batches of pages
become Arrow batches of chunks, and the rows stay in order. (`long_pages` splits a very long page by
meaning in many tasks.)

Fixed chunks: a page is cut at the first separator of `SEPARATORS` that it has,
which stays at the head of what follows it. Pieces of at least ``size`` are cut
again by the separators behind that one, and between any two characters in the
end. Neighbouring shorter pieces are put together up to ``size``; the next chunk
begins with as many of the last pieces as ``overlap`` allows. Chunks are stripped,
and empty ones dropped.

Chunks by meaning: sentences end at white space behind ``.``, ``?`` or ``!``; each is
embedded together with ``buffer`` sentences on either side. A chunk ends where the
cosine distance to the next sentence lies above the page's percentile ``threshold``
(linear between values), unless it is shorter than ``min_size``: then it goes on.

Defined results: null text is an empty page; an empty page has no fixed chunk,
and by meaning one that is empty; nulls in other columns are carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.config import ChunkConfig
from papyrion.operators.order import MEASURES, measured

# Separators, from strong to weak; between any two characters after that.
SEPARATORS = ("\n\n", "\n", " ")

_SENTENCE = re.compile(r"(?<=[.?!])\s+")

Embedder = Callable[[list[str]], np.ndarray]


def _cut(text: str, low: int, high: int, separator: str) -> Iterator[tuple[int, int]]:
    """Slices of ``text[low:high]`` that begin at each separator."""
    at = text.find(separator, low, high)
    while at >= 0:
        if at > low:
            yield low, at
        low, at = at, text.find(separator, at + len(separator), high)
    if low < high:
        yield low, high


def _join(run: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of a run of pieces that follow each other, each shorter than ``size``."""
    first = 0
    for k, (start, end) in enumerate(run):
        if end - run[first][0] > size:
            yield run[first][0], start
            # Keep the longest tail that fits the overlap, and the chunk together with this piece.
            least = max(start - overlap, end - size)
            while first < k and run[first][0] < least:
                first += 1
    if run:
        yield run[first][0], run[-1][1]


def _slices(text: str, low: int, high: int, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    used = next((k for k, s in enumerate(separators) if text.find(s, low, high) >= 0), None)
    if used is None:  # single characters: windows of equal width
        while high - low > size:
            yield low, low + size
            low += size - overlap
        yield low, high
        return
    run: list[tuple[int, int]] = []
    for start, end in _cut(text, low, high, separators[used]):
        if end - start < size:
            run.append((start, end))
            continue
        yield from _join(run, size, overlap)
        run = []
        yield from _slices(text, start, end, separators[used + 1 :], size, overlap)
    yield from _join(run, size, overlap)


def fixed_chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of one page."""
    out = []
    for low, high in _slices(text, 0, len(text), SEPARATORS, size, overlap):
        tail = text[low:high].lstrip()
        if chunk := tail.rstrip():
            out.append((high - len(tail), chunk))
    return out


class _Buckets(dict):
    """Token to bucket, found once for each token."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        head = hashlib.md5(token.encode()).hexdigest()[:2]
        self[token] = found = (ord(head[0]) * 16 + ord(head[1])) % self.dims
        return found


#: One table for each number of dimensions in a worker.
_buckets = lru_cache(_Buckets)


#: Tokens that are counted together, and those of one text more.
COUNT_TOKENS = 1 << 13


class HashEmbedder:
    """Counts of tokens by the first byte of their MD5, modulo ``dims``: a stand-in for a model, the same in SQL."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, bucket = np.zeros((len(texts), self.dims)), _buckets(self.dims).__getitem__
        low = 0
        while low < len(texts):
            # Texts are counted together, as many as have `COUNT_TOKENS` tokens.
            found, ends = [], []
            while low + len(ends) < len(texts) and len(found) < COUNT_TOKENS:
                found += map(bucket, texts[low + len(ends)].split())
                ends.append(len(found))
            rows = np.repeat(np.arange(len(ends)) * self.dims, np.diff(ends, prepend=0))
            counts = np.bincount(rows + np.array(found, np.int64), minlength=len(ends) * self.dims)
            out[low : low + len(ends)] = counts.reshape(len(ends), self.dims)
            low += len(ends)
        return out


def cosine_distances(vectors: np.ndarray) -> np.ndarray:
    """Between each vector and the next; a vector of zeros is at distance 1 from any."""
    squares = (vectors * vectors).sum(axis=1)
    dots = (vectors[:-1] * vectors[1:]).sum(axis=1)
    norms = np.sqrt(squares[:-1] * squares[1:])
    return np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), 1.0).round(9)


def sentences_of(text: str) -> list[str]:
    """A text cut at the white space behind the signs that end a sentence; an empty text is one empty sentence."""
    return _SENTENCE.split(text)


def _windows(sentences: list[str], buffer: int) -> list[str]:
    """Each sentence with its neighbours; none if there is nothing to compare."""
    return [" ".join(sentences[max(0, i - buffer) : i + buffer + 1]) for i in range(len(sentences))] if len(sentences) > 1 else []


def _grouped(sentences: list[str], vectors: np.ndarray, config: ChunkConfig) -> list[tuple[int, str]]:
    cuts: list[int] = []
    if len(sentences) > 1:
        distances = cosine_distances(vectors)
        cuts = np.flatnonzero(distances > np.percentile(distances, config.threshold)).tolist()
    out, first, at = [], 0, 0
    for cut in cuts:
        chunk = " ".join(sentences[first : cut + 1])
        if len(chunk) >= config.min_size:
            out.append((at, chunk))
            first, at = cut + 1, at + len(chunk)
    if first < len(sentences):
        out.append((at, " ".join(sentences[first:])))
    return out


def _embedded(windows: list[str], embed: Embedder) -> np.ndarray | None:
    """A vector for each window; None if the embedder fails."""
    try:
        vectors = np.asarray(embed(windows), np.float64) if windows else np.empty((0, 0))
        if len(vectors) != len(windows):
            raise ValueError("the embedder gives another number of vectors than texts")
    except Exception:  # noqa: BLE001  whatever a model raises
        return None
    return vectors


def semantic_pages(texts: list[str], embed: Embedder, config: ChunkConfig) -> list[list[tuple[int, str]] | None]:
    """`semantic_chunks` of several pages with one call of the embedder; None for a page that it fails on."""
    cut = [_SENTENCE.split(t) for t in texts]
    around = [_windows(sentences, config.buffer) for sentences in cut]
    vectors = _embedded([w for windows in around for w in windows], embed)
    if vectors is None:  # which page it was shows when they are asked one by one
        alone = [_embedded(windows, embed) for windows in around] if len(texts) > 1 else [None]
        return [None if own is None else _grouped(sentences, own, config) for sentences, own in zip(cut, alone)]
    ends = np.cumsum([len(w) for w in around])
    return [_grouped(sentences, vectors[end - len(w) : end], config) for sentences, w, end in zip(cut, around, ends.tolist())]


def semantic_chunks(text: str, embed: Embedder, config: ChunkConfig) -> list[tuple[int, str]]:
    """(start, chunk) of one page; starts add up the lengths of the chunks before."""
    sentences = _SENTENCE.split(text)
    windows = _windows(sentences, config.buffer)
    return _grouped(sentences, np.asarray(embed(windows), np.float64) if windows else np.empty((0, 0)), config)


#: Pages whose sentences are embedded in one call.
EMBED_PAGES = 64


def split_pages(pages: DataFrame, config: ChunkConfig, embed: Embedder | None = None, measure: bool = False) -> DataFrame:
    """(batch_id, page_no, piece, start_index, failed, text) of each chunk, in the order of the pages.

    ``pages``: (batch_id, page_no, text) and, from `route`, ``strategy_executed``;
    without that column, the strategy of ``config`` holds for all. By meaning only
    if there is an embedder; a page that the embedder fails on gets fixed chunks, marked
    ``failed``. With ``measure``, also with what `order.measured` adds, for `order.numbered`.
    """
    chosen = F.col("strategy_executed") if "strategy_executed" in pages.columns else F.lit(executed(config.strategy, embed))
    rows = pages.select("batch_id", "page_no", F.col("text").cast("string").alias("text"), chosen.alias("strategy"))

    def found_of(texts: list[str], strategies: list[str]) -> Iterator[tuple[int, bool, list[tuple[int, str]]]]:
        asked = [i for i, s in enumerate(strategies) if s == "semantic"]
        meant = dict(zip(asked, semantic_pages([texts[i] for i in asked], embed, config))) if asked else {}
        for i, text in enumerate(texts):
            made = meant.get(i)
            yield i, i in meant and made is None, fixed_chunks(text, config.size, config.overlap) if made is None else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, failed, chunks = [], [], [], [], []
            for low in range(0, batch.num_rows, EMBED_PAGES):
                texts = [t.as_py() or "" for t in batch.column(2)[low : low + EMBED_PAGES]]
                for i, bad, found in found_of(texts, batch.column(3)[low : low + EMBED_PAGES].to_pylist()):
                    at += [low + i] * len(found)
                    failed += [bad] * len(found)
                    piece += range(len(found))
                    start += [s for s, _ in found]
                    chunks += [c for _, c in found]
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(failed, pa.bool_()), pa.array(chunks, pa.string())],
                ["batch_id", "page_no", "piece", "start_index", "failed", "text"],
            )

    made = [
        rows.schema["batch_id"],
        rows.schema["page_no"],
        T.StructField("piece", T.IntegerType()),
        T.StructField("start_index", T.IntegerType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
    if measure:
        return rows.mapInArrow(lambda batches: measured(run(batches)), T.StructType([*made, *MEASURES.fields]))
    return rows.mapInArrow(run, T.StructType(made))


def executed(strategy: str, embed: Embedder | None) -> str:
    return "semantic" if strategy == "semantic" and embed is not None else "fixed"


def route(pages: DataFrame, config: ChunkConfig, embed: Embedder | None = None) -> DataFrame:
    """``pages`` with the strategy asked for, executed and reported.

    ``hybrid`` goes by the number of pages of the batch. ``semantic`` without an
    embedder is executed as fixed chunks but reported as asked for.
    """
    asked = config.strategy
    if asked != "hybrid" or embed is None:
        done = executed(asked, embed)
        reported = "semantic" if asked == "semantic" else "fixed"
        return pages.withColumns({"strategy_requested": F.lit(asked), "strategy_executed": F.lit(done), "strategy_reported": F.lit(reported)})
    counts = pages.groupBy(F.col("batch_id").alias("__batch")).agg(F.count("*").alias("n_pages"))
    joined = pages.join(counts, F.col("batch_id").eqNullSafe(F.col("__batch")), "inner").drop("__batch")
    done = F.when(F.col("n_pages") <= config.hybrid_pages, "semantic").otherwise("fixed")
    return joined.withColumns({"strategy_requested": F.lit(asked), "strategy_executed": done, "strategy_reported": done}).drop("n_pages")
