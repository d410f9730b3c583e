import zlib

import duckdb
import numpy as np

import corpus_pipeline
from papyrion.llm import pii, quality, tokens
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as near_classes
from tests.llm.test_tokens import check_pieces, whole

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    bench = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    good = [r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP7_SQL}) WHERE kept").fetchall()]
    texts = {k: texts[k] for k in good}
    texts = {k: texts[k] for k in {c for c, _ in near_classes(texts).values()}}
    texts = {k: texts[k] for k, _, hit, _ in contaminated(texts.items(), bench) if not hit}
    texts = {k: pii.mask(t, pii.find_spans(t)) for k, t in texts.items()}
    encoder = tokens.encoder(tokens.default_tokenizer())
    want = {k: whole(encoder, t) + [1] for k, t in texts.items()}
    assert 0 < len(want) < 200
    rows = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    for r in rows:
        r["ids_crc32"] = zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    assert check_pieces(rows, want) < 0.05


def test_stages_with_odd_rows(spark):
    rows = [
        (None, None, None, None, None, 0, "a"), (1, "", "en", "s", 0, 1, "b"), (1, "", "en", "s", 0, 1, "b"),
        (2, "the and of to in " * 40, "en", None, None, 2, "c"), (None, "x", "en", "s", 1, 3, "d"), (3, "the word a@b.cd " + "of one is an " * 20, "en", "s", 9, 4, None),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, r int, quality string"
    docs = spark.createDataFrame(rows, names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0), docs.select("doc_id", "text", "lang", "source", "n_chars")):
            made = stage(spark, given, SF)
            assert made.columns == given.columns and made.dtypes == given.dtypes
            assert made.count() <= given.count()
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 5
    assert corpus_pipeline.personal_data(spark, docs, SF).count() == 6
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == 6
