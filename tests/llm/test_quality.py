import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import quality as Q

STOP = {w for words in Q.STOP_WORDS.values() for w in words.split()}


def brute(text):
    """The counts, base_failed and kept, from the words and lines one by one."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(3))
    n, symbols = len(words), sum(c in Q.SYMBOLS for c in text)
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    stop, shout = sum(w.lower() in STOP for w in words), sum(len(w) > 2 and w.upper() == w and w.lower() != w for w in words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    good = not n or (2 <= chars / n <= 15 and symbols / n <= 0.1 and stop / n >= 0.05 and shout / n <= 0.3 and dup / len(lines) <= 0.3)
    return n, chars, symbols, dup, len(covered), failed, not failed and good


def found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r.quality for r in Q.with_quality(docs).collect()}
    return [(q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed, q.kept) for q in (rows[i] for i in range(len(texts)))]


def test_counts_against_words_one_by_one(spark):
    dice = random.Random(3)
    parts = ["the", "of", "and", "word", "LOUD", "é", "日本", "#", "a&b", "\x1c", "\xa0", "x" * 30, "is"]
    gaps = [" ", " ", " ", "\n", "\t", "\r\n", "\x0b", "  \n\n"]
    texts = ["".join(dice.choice(parts) + dice.choice(gaps) for _ in range(dice.choice((0, 1, 2, 3, 40, 80, 200)))) for _ in range(150)]
    texts += ["the line of words that is kept\n" * k + " ".join(f"w{i} of the" for i in range(60)) for k in (0, 1, 2, 9)]
    texts += [None, "", " \n\t ", "the and of to in " * 60, "\n" * 500, "the " + "y" * 100_000]
    got = found(spark, texts)
    assert got == [brute(t) for t in texts]
    assert {True, False} == {x[-1] for x in got}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t", max_size=80), min_size=1, max_size=20))
def test_counts_of_any_text(spark, texts):
    assert found(spark, texts) == [brute(t) for t in texts]


def test_rows_and_columns_are_kept(spark):
    good = " ".join(f"w{i} of the" for i in range(60))
    rows = [(1, good, "a", "b", 1), (1, good, "a", "b", 1), (None, good, None, None, None), (2, None, "c", "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __words string, __quality_of_row string, quality int")
    assert sorted(map(tuple, Q.keep_good(docs).collect()), key=repr) == sorted(rows[:3], key=repr)
    assert Q.keep_good(docs).columns == docs.columns and Q.keep_good(docs.limit(0)).count() == 0
    plan = Q.op7_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
