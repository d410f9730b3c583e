import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The base spans straight from the patterns."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            )
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base(text):
    return [f"{k}:{s}:{e}" for k, s, e, _ in pii.find_spans(text) if k in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_.@-+ 0129()é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == plain_spans(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_added_kinds_and_context():
    text = "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789"
    assert [x[:3] for x in pii.find_spans(text) if x[0] not in pii.BASE] == [("iban", 5, 32), ("ssn", 41, 52)]
    assert not pii.find_spans("part no 123-45-6789")  # no context word
    far = pii.find_spans("9" * 5 + " mail a@b.cd")[0][3]
    assert far > pii.find_spans("x a@b.cd")[0][3]


def test_long_runs_stay_linear():
    for unit in ("1", "a", "1.", "+1", "a@", "1 "):
        pii.find_spans(unit * 50_000)


def test_rows_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "mail a@b.cd", "x", 11), (1, "mail a@b.cd", "x", 11), (None, None, None, None), (2, "", "y", 0)],
        "doc_id long, text string, pii string, n_chars long",
    )
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "mail [EMAIL]", "x", 12)] * 2 + [(None, None, None, None), (2, "", "y", 0)], key=repr
    )
    assert [len(r.pii) for r in pii.with_pii(docs).orderBy("doc_id").collect()] == [0, 1, 1, 0]
    assert pii.with_pii(docs.limit(0)).count() == 0


def test_query_against_the_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_ibans_of_more_countries():
    ibans = (
        "LT121000011101001000 LV80BANK0000435195001 EE382200221020145685 SI56263300012039086 SK3112000000198742637541 "
        "HR1210010051863000160 BG80BNBG96611020345678 RO49AAAA1B31007593840000 CY17002001280000001200527600 "
        "MT84MALT011000012345MTLCAST001S TR330006100519786457841326 SA0380000000608010167519"
    ).split()
    for iban in ibans:
        assert pii.mod97(iban)
        spaced = " ".join(iban[k : k + 4] for k in range(0, len(iban), 4))
        for text in (f"to {iban}.", f"to {spaced} and on"):
            shown = iban if iban in text else spaced
            assert ("iban", 3, 3 + len(shown)) in [x[:3] for x in pii.find_spans(text)]
        wrong = iban[:2] + f"{(int(iban[2:4]) + 1) % 97:02d}" + iban[4:]
        assert "iban" not in [x[0] for x in pii.find_spans(f"to {wrong}.")]


def test_a_number_behind_another_is_found_too():
    text = "NO9386011117947 BE68539007547034, NO93 8601 1117 947 DE89370400440532013000 XX00 NO93860111179471"
    assert [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"] == ["NO9386011117947", "BE68539007547034", "NO93 8601 1117 947", "DE89370400440532013000"]


def test_scores_and_clashing_names_of_redacted_rows(spark, tmp_path):
    rows = [(1, "card 4111 1111 1111 1111 or 4111111111111111" + " x" * 60 + " 4111111111111111", "a", "b", 3), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, masked string, n_chars int")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text.startswith("card [CARD] or [CARD] x") and got[1].n_chars == len(got[1].text) and (got[1].spans, got[1].masked) == ("a", "b")
    assert got[2] == (2, None, None, None, None)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.scores for r in pii.op8_pii(spark, str(tmp_path)).collect()} == {1: "1.0,1.0,0.8", 2: ""}


def test_the_sql_says_the_same(tmp_path):
    texts = [
        "IBAN NO9386011117947 and DE89 3704 0044 0532 0130 00, ssn 123-45-6789 or 123-45-6789.", "number 123-45-6789", "social 000-12-3456 666-12-3456 912-12-3456 123-00-3456 123-45-0000 1123-45-6789",
        "é 日本 +49 (30) 123-45 67 call 1.2.3.4.5 or 256.1.1.1 or 01.002.0003.255, 4111-1111 1111 1111", "a@b.c.d x@y a.b+c@d-e.fr@g.h", "GB82WEST12345698765432X GB82WEST12345698765432 XX89370400440532013000", "", None,
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r[0]: r[6:9] for r in con.execute(pii.OP8_SQL).fetchall()}
    found = {i: pii.find_spans(t or "") for i, t in enumerate(texts)}
    assert got == {i: (",".join(f"{k}:{s}:{e}" for k, s, e, _ in f), ",".join(str(x[3]) for x in f), len(f)) for i, f in found.items()}
    assert {"iban", "ssn", "email", "ip", "card", "phone"} == {x[0] for f in found.values() for x in f}
