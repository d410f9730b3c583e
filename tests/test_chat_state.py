from papyrion.operators import chat


def test_a_null_session_is_one_session(spark):
    kinds = [("message", 1), ("save", 1), ("message", 2), ("error", 2), ("save", 2), ("error", 2), ("save", 3), ("delete", 3), ("load", 1), ("error", 1)]
    rows = [(session, seq, kind, conv) for session in (7, None) for seq, (kind, conv) in enumerate(kinds)]
    rows += [(8, 0, "save", 1), (8, 1, "new", None)]
    log = spark.createDataFrame(rows, "session_id long, seq long, kind string, conv_id long")
    by = lambda df, key: [tuple(x for c, x in r.asDict().items() if c != "session_id") for r in df.collect() if r.session_id == key]
    for found, want in (
        (chat.recent(chat.history(log)), [(1, 1, 2), (2, 2, 2)]),
        (chat.errors(log), [(3, 1)]),
        (chat.current(log), [(1,)]),
        (chat.state(log), [(2, 2, 1)]),
    ):
        assert sorted(by(found, None)) == sorted(by(found, 7)) == want
    assert by(chat.state(log), 8) == [(0, 1, None)]
