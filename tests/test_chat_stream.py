"""The state of sessions as a stream, against the same state by query, in any number of micro-batches."""

import pytest

from papyrion.operators import chat
from papyrion.plans import catalog
from papyrion.streaming import chat as live


@pytest.fixture(scope="module")
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, live.STORE)
    yield
    spark.conf.unset(name)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("session_id", "n_messages", "n_saved", "conv_id")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kinds", [catalog.CLEARING, catalog.RESETTING])
@pytest.mark.parametrize("cuts", [(1.0,), (0.3, 0.31, 1.0)])
def test_a_log_in_micro_batches(spark, store, tmp_path, kinds, cuts):
    log = catalog._log(spark, "/root/testdata/sf0.001", kinds).select("session_id", "seq", "kind", "conv_id")
    log = log.selectExpr("CASE WHEN session_id % 7 = 0 THEN NULL ELSE session_id END session_id", "seq", "kind", "CASE WHEN conv_id % 5 = 0 AND kind <> 'load' AND kind <> 'delete' AND kind <> 'save' THEN NULL ELSE conv_id END conv_id")
    log.write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    top, low = log.selectExpr("max(seq)").first()[0], -1
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k, cut in enumerate(cuts):
        part = log.where(f"seq > {low} AND seq <= {int(top * cut)}").repartition(3) if k else log.where(f"seq <= {int(top * cut)}")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        low = int(top * cut)
        live.follow(stream, f"{tmp_path}/states", f"{tmp_path}/check", once=True).awaitTermination(240)
        states = spark.read.parquet(f"{tmp_path}/states")
        # After each step the stream says what the query says of the events so far.
        assert rows_of(live.latest(states)) == rows_of(chat.state(log.where(f"seq <= {low}")))
    assert spark.read.parquet(f"{tmp_path}/states").select("batch").distinct().count() == len(cuts)
