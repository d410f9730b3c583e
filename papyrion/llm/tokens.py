"""Whole texts to token ids with a public tokenizer file.

`Encoder` gives the ids that the tokenizers library gives for the whole text, but
hands the library each distinct piece of text only once per worker. A byte-level
tokenizer first cuts a text by a pattern. Two kinds of places are borders of
that pattern in any text, so what stands between two of them is encoded on its own
with the same ids:

* before a run of ASCII white space, and before its last character if a word follows
  (which takes a space along);
* behind a letter, if an ASCII sign that is no letter, digit or space follows.

The borders of a block of texts are found with array operations on its bytes; a
piece of at most `KEY_BYTES` bytes is its own key, as two integers, in a hash table of
pieces with known ids, and only new and longer pieces go to the library. A text in
which other white space touches ASCII white space, or which holds the string of an
added token, goes there whole, as does every text if the tokenizer is not of that kind.

Sentences are found in the text, not in the tokens (`sentence_gaps`). A sentence ends
with ``.``, ``!``, ``?`` or an ellipsis, closing signs behind it taken along, if white space
follows and then no small ASCII letter; with a full stop of full width; or at a blank line. A single dot
behind a digit, a single letter or a capitalised word of two or three letters ends none, since it
may mark a number, an initial or a title.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers before it starts afresh; about 60 bytes each.
CACHE_PIECES = 1 << 20
#: The longest piece that is remembered; its length takes the last byte of its key.
KEY_BYTES = 15
#: Bytes of text that are cut at once, about; a longer text is cut at a space.
BLOCK_BYTES = 1 << 19

_NO_LETTER = rb"[\x00-/:-@\[-`{-\x7f]"
_CLOSING = rb"(?:[\"')\]}]|\xc2\xbb|\xe2\x80[\x99\x9d])*+"
_SIGNS = rb"(?:[.!?]|\xe2\x80\xa6)*+"
# The dot behind a single letter or a short capitalised word.
_SHORT = b"".join(rb"(?<!" + before + word + rb"\.)" for before in (_NO_LETTER, rb"^") for word in (rb"[A-Za-z]", rb"[A-Z][a-z]", rb"[A-Z][a-z][a-z]"))
# It begins with one class of bytes, so that the search passes over all others quickly.
_SENTENCE_END = re.compile(
    rb"[.!?\n\xe2\xe3](?:"
    + rb"(?:(?<=\.)(?:(?=[.!?]|\xe2\x80\xa6)|(?<![0-9]\.)" + _SHORT + rb")|(?<=[!?])|(?<=\xe2)\x80\xa6)" + _SIGNS + _CLOSING + rb"(?P<space>[ \t-\r]++)(?![a-z])"
    + rb"|(?<=\xe3)\x80\x82" + _CLOSING + rb"(?P<after>[ \t-\r]*+)"
    + rb"|(?<=\n)[ \t\r]*+\n[ \t-\r]*+)"
)

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_SIGN = (_BYTES < 128) & ~_SPACE & ~_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))
#: First bytes of white space beyond ASCII: U+0085, U+00A0; U+1680; U+2000 to U+205F; U+3000.
_WIDE_SPACE = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def default_tokenizer() -> str:
    """Path of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces:
    """Ids by piece: an open hash table of keys, and one flat array of ids.

    Entries behind ``n`` belong to the block at hand and are not remembered.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.ids, self.bounds = np.zeros(1 << 12, "<u4"), np.zeros(1 << 10, np.int64)
        self.n = 0

    def clear(self) -> None:
        self.high[:] = 0
        self.n = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _MIX[0]
        h ^= high * _MIX[1]
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1. No key has a high half of 0, which marks an empty slot."""
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, self.entry[slot], -1)
        left = np.flatnonzero(~hit & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.high[slot]
            hit = (there == high[left]) & (self.low[slot] == low[left])
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def keep(self, low: np.ndarray, high: np.ndarray) -> None:
        """Remember the first entries of the block at hand under these keys, which are new and different."""
        left, slot = np.arange(len(low)), self._slot(low, high)
        while len(left):
            free = self.high[slot] == 0
            self.entry[slot[free]] = left[free] + self.n
            won = np.zeros(len(left), bool)
            won[free] = self.entry[slot[free]] == left[free] + self.n  # of several, one has the slot
            self.low[slot[won]], self.high[slot[won]] = low[left[won]], high[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        self.n += len(low)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put entries behind the remembered ones, in the place of those of the block before."""
        start = int(self.bounds[self.n])
        if len(self.ids) < start + len(ids):
            self.ids = np.concatenate([self.ids[:start], np.zeros(start + 2 * len(ids), "<u4")])
        if len(self.bounds) < self.n + len(sizes) + 1:
            self.bounds = np.concatenate([self.bounds[: self.n + 1], np.zeros(self.n + 2 * len(sizes), np.int64)])
        self.ids[start : start + len(ids)] = ids
        self.bounds[self.n + 1 : self.n + len(sizes) + 1] = start + np.cumsum(sizes)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each run from its start, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.by_piece = (
            isinstance(pre, ByteLevel)
            and not pre.add_prefix_space
            and pre.use_regex
            and self.tokenizer.normalizer is None
            and self.tokenizer.post_processor is None
            and all(self.added)
        )
        self.pieces = _Pieces(most)
        # Bytes that each id stands for: a byte-level token has one character a byte.
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and their numbers."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _learn(self, raw: bytes, sizes: np.ndarray) -> None:
        """Ids of pieces, given one behind the other. Those of a space and a word are read as one text, 256 at a time."""
        ends = np.cumsum(sizes)
        data = np.frombuffer(raw, np.uint8)
        spaced = (data[ends - sizes] == 32) & (sizes > 1) & ~_SPACE[data[np.minimum(ends - sizes + 1, len(data) - 1)]] & (sizes <= KEY_BYTES)
        counts = np.zeros(len(sizes), np.int64)
        groups, plain = [], np.flatnonzero(spaced)
        parts = np.frombuffer(b"".join([raw[a:b] for a, b in zip((ends - sizes)[plain].tolist(), ends[plain].tolist())]), np.uint8)
        own = np.concatenate([[0], np.cumsum(sizes[plain])])
        for k in range(0, len(plain), 256):
            text = parts[own[k] : own[min(k + 256, len(plain))]].tobytes().decode()
            ids = self._library([text])[0]
            last = np.searchsorted(np.cumsum(self.widths[ids]), own[k + 1 : k + 257] - own[k], "left") + 1
            counts[plain[k : k + 256]] = np.diff(last, prepend=0)
            groups.append(ids)
        rest = np.flatnonzero(~spaced)
        ids, counts[rest] = self._library([raw[a:b].decode() for a, b in zip((ends - sizes)[rest].tolist(), ends[rest].tolist())])
        # Back into the order of the pieces.
        flat = np.concatenate([*groups, ids])
        begun = np.zeros(len(sizes), np.int64)
        order = np.concatenate([plain, rest])
        begun[order] = np.cumsum(counts[order]) - counts[order]
        self.pieces.add(flat[_runs(begun, counts)], counts)

    def _odd(self, data: np.ndarray, space: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that the library has to see whole."""
        found = []
        at = np.flatnonzero(_WIDE_SPACE[data])
        if len(at):
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            a, b, c = padded[at], padded[at + 1], padded[at + 2]
            two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            three |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | np.isin(c, [0xA8, 0xA9, 0xAF]))) | ((b == 0x81) & (c == 0x9F)))
            three |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
            wide, width = at[two | three], np.where(two, 2, 3)[two | three]
            beside = np.concatenate([[False], space, [False] * 3])
            found.append(wide[beside[wide] | beside[wide + width + 1]])
        raw = None
        for token in self.added:
            raw = raw or data.tobytes()
            k = raw.find(token)
            while k >= 0:
                found.append(np.array([k]))
                k = raw.find(token, k + 1)
        if not found:
            return np.empty(0, np.int64)
        return np.unique(np.searchsorted(offsets, np.concatenate(found), "right") - 1)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[k]:offsets[k + 1]]``, one behind the other, and where each begins and ends."""
        size = len(data)
        if not size:
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        space = _SPACE[data]
        letter = _LETTER[data]
        two = np.flatnonzero(data == 0xC3)  # é, ü, ñ and such: all but × and ÷
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        letter[two + 1] = True
        full = offsets[:-1][np.diff(offsets) > 0]
        start = space.copy()
        start[1:] &= ~space[:-1]
        before = space[:-1] & ~space[1:]  # the last space of a run, unless the text ends with it
        before[full[1:] - 1] = False
        start[:-1] |= before
        start[1:] |= letter[:-1] & _SIGN[data[1:]]
        odd = self._odd(data, space, offsets) if self.by_piece else np.flatnonzero(np.diff(offsets))
        for k in odd.tolist():
            start[offsets[k] : offsets[k + 1]] = False
        start[full] = True
        starts = np.flatnonzero(start)
        sizes = np.diff(starts, append=size)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray(size + 8, "<u8", padded, strides=(1,))
        low = words[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, size + 7)] & _FIRST_BYTES[np.clip(sizes - 8, 0, 7)]
        high |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        short = sizes <= KEY_BYTES
        short[np.searchsorted(starts, offsets[odd])] = False
        pieces = self.pieces
        if pieces.n + len(starts) > pieces.most:
            pieces.clear()
        entry = np.where(short, pieces.find(low, high), -1)
        new = np.flatnonzero((entry < 0) & short)
        order = new[np.lexsort((low[new], high[new]))]
        other = np.ones(len(order), bool)
        other[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        first, alone = order[other], np.flatnonzero(~short)
        if len(first) + len(alone):
            made = np.concatenate([first, alone])
            entry[order] = pieces.n + np.cumsum(other) - 1
            entry[alone] = pieces.n + len(first) + np.arange(len(alone))
            self._learn(data[_runs(starts[made], sizes[made])].tobytes(), sizes[made])
        begun = pieces.bounds[entry]
        counts = pieces.bounds[entry + 1] - begun
        ids = pieces.ids[_runs(begun, counts)]
        first = first[: pieces.most - pieces.n]
        pieces.keep(low[first], high[first])
        so_far = np.concatenate([[0], np.cumsum(counts)])
        return ids, so_far[np.searchsorted(starts, offsets)]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, in parts that end before a space between ASCII letters."""
        if not self.by_piece or len(self._odd(data, _SPACE[data], np.array([0, len(data)]))):
            return self._library([data.tobytes().decode()])[0]
        out, low = [], 0
        while low < len(data):
            high = low + BLOCK_BYTES
            while high < len(data):
                part = data[high - 1 : high + BLOCK_BYTES]
                fits = (part[1:-1] == 32) & _LETTER[part[:-2]] & _LETTER[part[2:]]
                if fits.any():
                    high += int(fits.argmax())
                    break
                high += BLOCK_BYTES
            high = min(high, len(data))
            out.append(self._block(data[low:high], np.array([0, high - low]))[0])
            low = high
        return np.concatenate(out)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids of some texts, where each text's ids begin and end). Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        k = 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK_BYTES, "right")) - 1)
            part = data[offsets[k] : offsets[end]]
            if len(part) > 2 * BLOCK_BYTES:
                ids = self._long(part)
                yield k, ids, np.array([0, len(ids)])
            else:
                yield k, *self._block(part, offsets[k : end + 1] - offsets[k])
            k = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Null counts as empty."""
        found = self.blocks(pa.array(texts, pa.large_string()))
        return [ids[a:b] for _, ids, bounds in found for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def sentence_cuts(self, raw: bytes | memoryview, ids: np.ndarray) -> np.ndarray:
        """The numbers of ids before the ends of sentences in a text, as UTF-8, where an id ends there; rising, the text's own end left out.

        If ids do not stand for the bytes of the text one by one, no end is known.
        """
        gaps = sentence_gaps(raw)
        if not len(gaps):
            return np.empty(0, np.int64)
        ends = np.cumsum(self.widths[ids])
        if ends[-1] != len(raw):
            return np.empty(0, np.int64)
        at = np.searchsorted(ends, gaps[:, 0])
        return np.unique(at[(ends[at] <= gaps[:, 1]) & (ends[at] < len(raw))] + 1)


def sentence_gaps(raw: bytes | memoryview) -> np.ndarray:
    """Of each sentence end in a text, as UTF-8, where the sentence ends and the next may begin (behind the white space)."""
    # A blank line is no group.
    return np.array([(end.start(end.lastgroup or 0), end.end()) for end in _SENTENCE_END.finditer(raw)], np.int64).reshape(-1, 2)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
