import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import packing, tokenfiles, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_tokenizer())


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "\n", "\t", "a", "B", "é", "'s", "'", "12", ".", "#", "!?", "÷", "\u3000", "\xa0", "\x1c", "\x85", "\x00", "\r", "  ", "\n\n", "<|endoftext|>", "日", "foo", "x" * 20, "😀"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS)).map("".join), max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    encoder = tokens.encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in encoder.encode(texts)] == [whole(encoder, t) for t in texts]


def test_blocks_long_texts_and_a_full_table(encoder, monkeypatch):
    dice = random.Random(4)
    word = lambda: "".join(dice.choice("abcdefghijkléü'") for _ in range(dice.randint(1, 18)))
    texts = ["".join(word() + dice.choice((" ", " ", ". ", "\n", "\n\n", "")) for _ in range(dice.choice((0, 1, 30, 900)))) for _ in range(40)] + [None, ""]
    want = [whole(encoder, t) for t in texts]
    for block in (1, 500, 1 << 20):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
        small = tokens.Encoder(tokens.default_tokenizer(), most=4096)
        for _ in range(2):
            assert [x.tolist() for x in small.encode(texts)] == want
            assert small.pieces.n <= 4096
    taken = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    found = [(k, ids, bounds) for k, ids, bounds in encoder.blocks(taken)]
    assert [ids[a:b].tolist() for _, ids, bounds in found for a, b in zip(bounds, bounds[1:])] == want
    assert [k for k, *_ in found] == np.cumsum([0] + [len(b) - 1 for *_, b in found[:-1]]).tolist()


def best(pos, penalty, capacity):
    """The least cost by trying every pair of cuts."""
    cost = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= capacity:
                padding = 0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else capacity - n
                cost[j] = min(cost[j], cost[i] + padding + penalty[j] + packing.SEQUENCE_PENALTY)
    return cost[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(1, 300), st.sampled_from([128, 256, 600])), st.sampled_from([0, 4, 12]), st.booleans()), min_size=1, max_size=60))
def test_cuts_cost_the_least_however_they_come(steps):
    pos = np.concatenate([[0], np.cumsum([s for s, *_ in steps])])
    penalty = np.array([0] + [p for _, p, _ in steps])
    made = []
    for at_once in (True, False):
        plan, cuts, low = packing.Cuts(600), [0], 1
        for k in range(1, len(pos)):
            if k == len(pos) - 1 or not at_once and steps[k - 1][2]:
                plan.add(pos[low : k + 1] - cuts[-1], penalty[low : k + 1])
                low, base = k + 1, cuts[-1]
                cuts += [base + c for c in plan.decided()]
        base = cuts[-1]
        made.append(cuts + [base + c for c in plan.ended()])
    assert made[0] == made[1]
    total = 0
    for a, b in zip(made[0], made[0][1:]):
        n = b - a
        assert 0 < n <= 600
        total += penalty[np.searchsorted(pos, b)] + packing.SEQUENCE_PENALTY + (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else 600 - n)
    assert made[0][-1] == pos[-1] and total == best(pos.tolist(), penalty.tolist(), 600)


def ends_sentence(text, at):
    """Does a sentence of ``text`` end at character ``at``, as a reader would say? A plain rule over the text."""
    before, after = text[max(0, at - 80) : at], text[at : at + 80]
    space = " \t\n\v\f\r"
    gap = before[len(before.rstrip(space)) :] + after[: len(after) - len(after.lstrip(space))]
    body, rest = before.rstrip(space).rstrip("\"')]}»’”"), after.lstrip(space)
    if re.search(r"\n[ \t\r]*\n", gap):
        return True
    if body.endswith("。"):
        return True
    if not gap or not body or body[-1] not in ".!?…" or re.match("[a-z]", rest):
        return False
    word = re.search(r"[^\W_]*$", body[:-1])[0]
    return body[-1] != "." or not (re.fullmatch("[A-Za-z]|[A-Z][a-z]{1,2}", word) or re.search("[0-9]$", word))


def cut_kinds(rows, texts, want, widths, capacity=2048):
    """How many sequences end at the end of a document, of a sentence, and inside one that fits or that doesn't."""
    last = {}
    for r in rows:
        last[r["sequence_id"]] = max(last.get(r["sequence_id"], (-1, 0, 0)), (r["offset"], r["doc_id"], r["start"] + r["length"]))
    kinds = dict.fromkeys(("document", "sentence", "inside", "inside long"), 0)
    for _, key, end in last.values():
        ids = np.array(want[key])
        if end == len(ids):
            kinds["document"] += 1
            continue
        text, raw = texts[key] or "", (texts[key] or "").encode()
        at = np.cumsum(widths[ids[:-1]])
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        is_end = [bool(b < len(raw) and raw[b] & 0xC0 != 0x80 and ends_sentence(text, int(chars[b - 1]))) for b in at.tolist()]
        if is_end[end - 1]:
            kinds["sentence"] += 1
        else:
            ends = np.concatenate([[0], np.flatnonzero(is_end) + 1, [len(ids)]])
            k = np.searchsorted(ends, end)
            kinds["inside long" if ends[k] - ends[k - 1] > capacity else "inside"] += 1
    return kinds


@pytest.mark.parametrize(
    "text, ends",
    [
        ("See www.example.com now. Then 3.14159, e.g. this. Write to a.b@c.org! Now", ["now.", "this.", "org!"]),
        ("Dr. Smith and J. Doe met. They spoke.", ["met."]),
        ("It is 3. 4 was last. Next", ["last."]),
        ("He said \"go.\" She went (far!) Then... Off… On?! Yes", ['go."', "far!)", "Then...", "Off…", "On?!"]),
        ("a wrapped\nline goes on.\nNew one\n\nand a paragraph", ["on.", "one"]),
        ("no end, approx. half? yes it is", []),
        ("一。二 había. Él", ["一。", "había."]),
        ("", []),
    ],
)
def test_sentence_ends(encoder, text, ends):
    raw = text.encode()
    found = [raw[:a].decode() for a, _ in tokens.sentence_gaps(raw)]
    assert len(found) == len(ends) and all(f.endswith(e) for f, e in zip(found, ends))
    ids = encoder.encode([text])[0]
    at = np.cumsum(encoder.widths[ids])
    assert all(ends_sentence(text, len(raw[: at[c - 1]].decode())) for c in encoder.sentence_cuts(raw, ids).tolist())


def check_pieces(rows, want, capacity=2048):
    """Every id in one piece; sequences gapless from 0 and within capacity; little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == want.keys()
    for key, ids in want.items():
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            piece = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = tokens_in = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        tokens_in += at
    return padding / max(1, tokens_in)


def test_packing_query(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: whole(encoder, d.text) + [1] for d in docs}
    rows = packing.op2_packing(spark, SF).collect()
    assert check_pieces(rows, want) < 0.02
    kinds = cut_kinds(rows, {d.doc_id: d.text for d in docs}, want, encoder.widths)
    assert kinds["sentence"] > 0 and kinds["inside"] == 0, kinds


def test_packing_does_not_depend_on_batches_and_takes_odd_rows(spark, encoder, monkeypatch):
    long = "word " * 9000 + "end"
    rows = [(1, "One. Two.", 0), (2, None, 0), (3, "", 0), (4, long, 0), (5, "x" * 5000, 0), (6, "Short one. " * 900, 0), (7, "A. B! C?\n" * 300, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").coalesce(1)
    got = packing.pack(docs, digest=True).collect()
    want = {k: whole(encoder, t) + [1] for k, t, _ in rows}
    check_pieces(got, want)
    kinds = cut_kinds(got, {k: t for k, t, _ in rows}, want, encoder.widths)
    assert kinds["inside"] == 0 and kinds["inside long"] >= 4, kinds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert packing.pack(docs, digest=True).collect() == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert packing.pack(docs.limit(0)).count() == 0
    ids = [list(r.ids) for r in packing.pack(docs).orderBy("doc_id", "start").collect()]
    assert sum(ids, []) == sum(want.values(), [])
    twice = packing.pack(docs.union(docs).where("doc_id = 1")).collect()
    assert sum(r.length for r in twice) == 2 * (len(whole(encoder, "One. Two.")) + 1)
    assert packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().doc_id is None
    named = packing.pack(spark.createDataFrame([("x-1", "a b. C d."), (None, "z")], "name string, text string"), key="name")
    assert sorted((r["name"] or "", r.doc_tokens) for r in named.collect()) == [("", 2), ("x-1", 7)]
    with pytest.raises(ValueError, match="named like"):
        packing.pack(docs.withColumnRenamed("doc_id", "length"), key="length")


def test_token_files_query(spark, encoder):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    start, want = 0, []
    for d in docs:
        ids = np.array(whole(encoder, d.text) + [0], dtype="<u4")
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfiles.op3_token_files(spark, SF)
    assert sorted(map(tuple, got.collect())) == want


def test_token_files_odd_rows_and_format(spark, encoder, tmp_path):
    import pyarrow.parquet as pq

    rows = [(2, "b c"), (1, None), (None, "z"), (3, "")] + [(7, f"hot {i}") for i in range(50)] + [(2, "b c")]
    path = f"file://{tmp_path}/files"
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, shards=5)
    got = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3] + [7] * 50
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
    assert {tuple(r.ids[:-1]) for r in got if r.doc_id == 7} == {tuple(whole(encoder, f"hot {i}")) for i in range(50)}
    file = next(p for p in (tmp_path / "files").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    chunk = pq.ParquetFile(file).metadata.row_group(0)
    assert all(chunk.column(i).has_column_index and chunk.column(i).has_offset_index for i in range(chunk.num_columns))
    assert "RLE_DICTIONARY" in chunk.column(4).encodings
    plan = tokenfiles.read_token_files(spark, path, ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    empty = f"file://{tmp_path}/none"
    tokenfiles.write_token_files(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert tokenfiles.read_token_files(spark, empty).count() == 0


def test_added_tokens_in_a_text_are_those_of_the_library(spark, encoder, tmp_path):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "a  <|endoftext|>", "plain words, here", "<|endoftext |> <|", "<|endoftext|"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start, files = 0, []
    for (key, _), ids in zip(rows, want):
        ids = np.array(ids + [0], dtype="<u4")
        files.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfiles.op3_token_files(spark, str(tmp_path)).collect())) == files
    check_pieces(packing.op2_packing(spark, str(tmp_path)).collect(), {key: ids + [1] for (key, _), ids in zip(rows, want)})
