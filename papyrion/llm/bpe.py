"""BPE encoding and decoding with an index of pair occurrences.

A tokenizer file of the tokenizers library gives the vocabulary, the ranks of pairs, the
normalizer, the pre-tokenizer and the added tokens; merging and decoding are done here.

A text is cut at ASCII white space, which the file's rules drop and never look across, so
each stretch between is encoded on its own, and once per worker. The stretches of
a block of texts that are new are cut into words by the file's rules, and all these words are
merged together (`Rules.merge`): their symbols lie end to end in one list, the index holds for
each rank the places of its pair, and the active ranks are taken in ascending order from a
heap. All places of a pair are merged at once, from left to right, and the pairs that come
about beside them are put into the lists of their own ranks; places whose pair has gone are
passed over. A symbol that is made at some rank only takes part in later ranks (this
is checked when a file is read), so this order gives each word the ids that
merging it alone would give.

Decoding takes ids alone: the tokens they stand for, joined by spaces, which is what the
library does with a file that names no decoder.

Defined results: a null or empty text has no ids and decodes to the empty text; a null list of ids
decodes to null; null keys and repeated rows stay; extra columns are not carried; an empty table
gives an empty table. A very long text is read in parts that end at white space.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stretches, and bytes of them, that a worker remembers before it starts afresh.
KNOWN_STRETCHES = 1 << 19
KNOWN_BYTES = 1 << 25
#: Bytes of text that are encoded together, about.
BLOCK_BYTES = 1 << 22
#: Ids that are turned into text at a time.
DECODE_IDS = 1 << 18

_SPACE = re.compile(rb"[ \t-\r]")
# The rules of the file that the query uses, under which a stretch of plain letters, signs
# behind them, is two words (an apostrophe may go with the letters behind it, so it is no such sign).
_PLAIN_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Letters of Latin-1, which NFC leaves as they are, and signs of ASCII.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    """Path of the vocabulary file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Rules:
    """Vocabulary and ranked pairs of a BPE model, as ids."""

    def __init__(self, model: dict):
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model['type']}, {odd}")
        self.ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pairs: list[tuple[int, int, int]] = []  # by rank: left, right, what they become
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.append((self.ids[a], self.ids[b], self.ids[a + b]))
        made = {whole: rank for rank, (_, _, whole) in enumerate(self.pairs)}  # the last rank that makes it
        for rank, (left, right, _) in enumerate(self.pairs):
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError(f"what takes part in the pair of rank {rank} may be made after it")
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.pairs)}

    def symbols(self, word: str) -> list[int]:
        """A word as the ids of its characters; one that the vocabulary lacks has none, as in the library."""
        found = [*map(self.ids.get, word[:-1]), self.ids.get(word[-1] + self.suffix)]
        return [i for i in found if i is not None] if None in found else found

    def merge(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and their numbers; words are given as the ids of their symbols."""
        symbol = list(chain.from_iterable(words))
        n, ends = len(symbol), np.cumsum([0, *map(len, words)])
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for end in ends.tolist():  # words do not touch
            if end < n:
                before[end] = -1
            if end:
                after[end - 1] = -1
        rank_of = self.rank.get
        index: dict[int, list[int]] = {}
        flat = np.array(symbol, np.int64)
        for i, r in enumerate(map(rank_of, (flat[:-1] << 32 | flat[1:]).tolist())):
            if r is not None and after[i] >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        active = list(index)
        heapify(active)
        while active:
            rank = heappop(active)
            left, right, whole = self.pairs[rank]
            for i in sorted(index.pop(rank)):
                j = after[i]
                # The pair may have gone since: a neighbour took one of its symbols.
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = whole, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(whole << 32 | symbol[k])) is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(active, r)
                h = before[i]
                if h >= 0 and (r := rank_of(symbol[h] << 32 | whole)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heappush(active, r)
        left_over = np.array(symbol, np.int64)
        counts = np.diff(np.concatenate([[0], np.cumsum(left_over >= 0)])[ends])
        return left_over[left_over >= 0].astype("<u4"), counts


class _Known(dict):
    """Numbers of stretches or words; one that is asked for and new gets the next number and waits in ``new``.

    What each stands for is a run of ``values``.
    """

    def __init__(self):
        super().__init__()
        self.new: list = []
        self.values, self.bounds = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        """What the keys that wait stand for."""
        self.values = np.concatenate([self.values, values])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.new = []

    def get_all(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers, one behind the other, and their lengths."""
        counts = self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.cumsum(counts)
        return self.values[np.repeat(self.bounds[numbers] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class Codec:
    def __init__(self, path: str, most: int = KNOWN_STRETCHES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.rules = Rules(described["model"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.most = library.normalizer, library.pre_tokenizer, most
        added = described["added_tokens"]
        if described.get("decoder") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _SPACE.search(t["content"].encode()) for t in added):
            raise ValueError("decoders, and added tokens that touch white space or are normalized, are not known here")
        self.plain = (described["normalizer"], described["pre_tokenizer"]) == _PLAIN_RULES
        # The characters that stand for the bytes of a letter, as the pre-tokenizer has them.
        self.letters = {ord(c): self.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"} if self.plain else {}
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})") if longest_first else re.compile("(?!)")
        self.tokens = [""] * (1 + max([*self.rules.ids.values(), *self.added.values()]))
        for token, i in chain(self.rules.ids.items(), self.added.items()):
            self.tokens[i] = token
        self._forget()

    def _forget(self) -> None:
        self.known, self.words, self.held = _Known(), _Known(), 0
        for i in self.added.values():  # each is a word of its own, under a name that no text has
            self.words[i] = len(self.words)
        self.words.add(np.fromiter(self.added.values(), "<u4"), np.ones(len(self.added), np.int64))

    def _cut(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(normal)] if self.pre_tokenizer else [normal]

    def _learn(self) -> None:
        """Ids of the stretches that wait, by way of their words."""
        number, numbers, counts = self.words.__getitem__, [], []
        for stretch in self.known.new:
            start, whole = len(numbers), stretch.decode()
            if self.plain and (found := _PLAIN.fullmatch(whole)):
                letters, signs = found.groups()
                numbers.append(number(letters.lower().translate(self.letters)))
                if signs:
                    numbers.append(number(signs))
                counts.append(len(numbers) - start)
                continue
            for k, text in enumerate(self.cut.split(whole)):
                if k % 2:
                    numbers.append(number(self.added[text]))
                elif text:
                    numbers += map(number, self._cut(text))
            counts.append(len(numbers) - start)
        self.held += sum(map(len, self.known.new))
        if self.words.new:
            self.words.add(*self.rules.merge([*map(self.rules.symbols, self.words.new)]))
        ids, sizes = self.words.get_all(np.array(numbers, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        self.known.add(ids, np.diff(ends, prepend=0))

    def _parts(self, texts: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        for k, raw in enumerate(texts):
            low = 0
            while len(raw) - low > 2 * BLOCK_BYTES and (space := _SPACE.search(raw, low + BLOCK_BYTES)):
                yield k, raw[low : space.start()]
                low = space.start()
            yield k, raw[low:] if low else raw

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Null counts as empty."""
        waiting: list[tuple[int, list[bytes]]] = []
        done: list[np.ndarray] = []  # parts of the text at hand
        at, size = 0, 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(w for _, w in waiting)), np.int64)
            if self.known.new:
                self._learn()
            flat, counts = self.known.get_all(numbers)
            ends = np.cumsum(counts)
            limits = np.concatenate([[0], ends])[np.cumsum([0] + [len(w) for _, w in waiting])].tolist()
            yield from zip((k for k, _ in waiting), (flat[a:b] for a, b in zip(limits, limits[1:])))
            waiting.clear()
            if len(self.known) > self.most or self.held > KNOWN_BYTES:
                self._forget()

        def ready(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
            nonlocal at
            for k, ids in found:
                if k != at:
                    yield np.concatenate(done)
                    done.clear()
                    at = k
                done.append(ids)

        for k, raw in self._parts((t or "").encode() for t in texts):
            waiting.append((k, raw.split()))
            size += len(raw) + 64
            if size >= BLOCK_BYTES:
                size = 0
                yield from ready(flush())
        yield from ready(flush())
        if done:
            yield np.concatenate(done)

    def decoded(self, ids: np.ndarray) -> Iterator[str]:
        """The text that ``ids`` stand for, in parts."""
        for low in range(0, len(ids), DECODE_IDS):
            yield (" " if low else "") + " ".join(map(self.tokens.__getitem__, ids[low : low + DECODE_IDS].tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def _mapped(df: DataFrame, key: str, value, fields: str, work) -> DataFrame:
    """(key, what ``work`` makes of the values of a batch), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(batch.column(1))], names)

    made = T.StructType.fromDDL(fields)
    chosen = df.select(F.col(f"`{key}`").alias("__key"), value.alias("__value"))
    names = ["__key", *made.names]
    return chosen.mapInArrow(run, T.StructType([chosen.schema["__key"], *made.fields])).withColumnRenamed("__key", key)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, ids) of each row's whole text."""
    path = tokenizer or default_tokenizer()

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([ids.astype(np.int32) for ids in codec(path).encode(texts.to_pylist())], pa.list_(pa.int32()))]

    return _mapped(docs, key, F.col(f"`{text}`").cast("string"), "ids array<int>", work)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(key, text) of each row's ids."""
    path = tokenizer or default_tokenizer()

    def work(lists: pa.Array) -> list[pa.Array]:
        return [pa.array([None if x is None else "".join(codec(path).decoded(np.array(x, np.int64))) for x in lists.to_pylist()], pa.string())]

    return _mapped(encoded, key, F.col(f"`{ids}`").cast("array<int>"), "text string", work)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and the ids decoded again, without either leaving the worker."""
    path = tokenizer or default_tokenizer()

    def work(texts: pa.Array) -> list[pa.Array]:
        both, counts, encoded, decoded = codec(path), [], [], []
        for ids in both.encode(texts.to_pylist()):
            counts.append(len(ids))
            encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
            made = hashlib.sha256()
            for part in both.decoded(ids):
                made.update(part.encode())
            decoded.append(made.hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(docs, key, F.col(f"`{text}`").cast("string"), "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op12_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
