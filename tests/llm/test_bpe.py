import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from papyrion.llm import bpe

PATH = bpe.default_tokenizer()
ODD = [
    None, "", " \n\t", "Hello  World's", "a <|endoftext|>b<|startoftext|><|endoftext|> c", "<|endoftext|", "aaaaaaaaaaa abababab aaab", "don'T 'S 'LL 'sll",
    "İstanbul ΑΣ ΣΑΣ ǅ ﬁ Å é ́x", "x y z\x85w\x1cq\x00r", "日本語 テスト 12345 3.14", "😀👨‍👩‍👧 ok", "a" * 5000, "ab" * 3000 + "!" * 999, "﻿x y",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(texts, found, codec, library):
    for text, ids in zip(texts, found, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert "".join(codec.decoded(ids)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("most, block", [(1 << 19, 1 << 22), (3, 40)])
def test_ids_and_texts_of_the_library(library, monkeypatch, most, block):
    random.seed(3)
    letters = "abcdeéüßñ ABC'st  \n.,!<|>123 ́"
    texts = ODD + ["".join(random.choices(letters, k=random.randint(0, 300))) for _ in range(200)] + ODD
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "DECODE_IDS", 7 if block == 40 else bpe.DECODE_IDS)
    codec = bpe.Codec(PATH, most)
    check(texts, list(codec.encode(texts)), codec, library)


def plain_merge(rules, symbols):
    """One word by itself: the pair of least rank, the first of equals, until none is left."""
    symbols = list(symbols)
    while True:
        ranks = [(rules.rank.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return symbols
        rank, i = min(ranks)
        symbols[i : i + 2] = [rules.pairs[rank][2]]


def test_merging_all_words_together_is_merging_each_alone():
    rules = bpe.codec(PATH).rules
    random.seed(4)
    words = [rules.symbols("".join(random.choices("aehinrstaaaa", k=random.randint(1, 14)))) for _ in range(400)] + [[], rules.symbols("a" * 101)]
    ids, counts = rules.merge(words)
    found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [plain_merge(rules, w) for w in words]


def test_a_file_whose_order_would_not_hold_is_refused():
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(["a", "b", "c", "ab", "abc"])}, "merges": ["ab c", "a b"]}
    with pytest.raises(ValueError, match="takes part"):
        bpe.Rules(model)
    with pytest.raises(ValueError, match="plain"):
        bpe.Rules(model | {"merges": ["a b", "ab c"], "unk_token": "a"})


def test_tables(spark, library, tmp_path):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(ODD)] + [(1, "Hello", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted(map(tuple, bpe.decode(encoded).collect()), key=repr)
    decoded = lambda t: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert got == sorted(((k, decoded(t)) for k, t, _ in rows), key=repr)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None
    assert bpe.encode(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def want(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded(text).encode()).hexdigest()

    got = [tuple(r) for r in bpe.op12_bpe_codec(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((want(k, t) for k, t, _ in rows), key=repr)


def test_query_against_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op12_bpe_codec(spark, d).collect()}
    for doc_id, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
