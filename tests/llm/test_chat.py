import duckdb

from papyrion.llm import chat


def test_three_speakers_nulls_ties_and_windows(spark, tmp_path):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo 😀"), (1, 3, "cy", None), (1, 4, "ann", "Bye"),
        (2, None, None, "who"), (2, 0, "ann", "me"), (None, 0, "ann", "lost"), (None, 1, "bob", "too"),
        (3, 0, "system", "only"), (4, 0, "ann", "same"), (4, 0, "ann", "same"),
        (4, 1, "ann", "b"), (4, 1, "ann", "a"), (4, 1, "ann", "é"),
    ]
    rows += [(9, i // 2, f"s{i % 3}", f"turn {i}") for i in range(700)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, participant string")
    got = chat.rotate(turns).collect()
    views = {(r.conv_id, r.participant, r.window): r for r in got}
    bob = views[1, "bob", 0]
    assert bob.rendered == (
        "<|system|>\nBe kind.<|end|>\n<|user:ann|>\nHi<|end|>\n<|assistant|>\nYo 😀<|end|>\n<|user:cy|>\n<|end|>\n<|user:ann|>\nBye<|end|>\n"
    )
    assert [bob.rendered[s.start : s.end] for s in bob.mask] == ["Yo 😀<|end|>"]
    assert {k for k in views if k[0] in (1, 2, 3, 4, None)} == {
        (1, "ann", 0), (1, "bob", 0), (1, "cy", 0), (2, "ann", 0), (2, "unknown", 0), (4, "ann", 0), (None, "ann", 0), (None, "bob", 0)
    }
    assert views[4, "ann", 0].n_turns == 5
    assert [views[9, "s0", w].n_turns for w in range(3)] == [256, 256, 188]
    assert views[9, "s0", 2].char_start == sum(len(views[9, "s0", w].rendered) for w in range(2))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(chat.OP4_SQL)
    names = [d[0] for d in cursor.description]
    want = {tuple(dict(zip(names, r))[c] for c in ("conv_id", "participant", "window")): dict(zip(names, r)) for r in cursor.fetchall()}
    assert want.keys() == views.keys()
    for k, r in views.items():
        assert (r.rendered, r.n_turns, r.char_start) == (want[k]["rendered"], want[k]["n_turns"], want[k]["char_start"])
        assert ",".join(f"{s.start}:{s.end}" for s in r.mask) == want[k]["mask"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_long_turns_are_dealt_into_parts(spark):
    rows = [(1, i, f"s{i % 2}", "é" * 70 if i % 3 else "") for i in range(600)] + [(2, 0, "a", "x" * 5000), (2, 1, "b", "y"), (None, 0, "a", "z" * 300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat.rotate(turns, chars=1000).collect()
    whole = {(r.conv_id, r.participant, r.window): r for r in chat.rotate(turns).collect()}
    assert {r.part for r in whole.values()} == {0}
    joined: dict[tuple, str] = {}
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.participant, r.window, r.part)):
        before = joined.setdefault((r.conv_id, r.participant), "")
        assert r.char_start == len(before)
        assert all(r.rendered[s.start : s.end].endswith("<|end|>") for s in r.mask)
        assert sum(len(t) for t in r.rendered.split("\n")[1::2]) <= 1000 + 5000 + 7 * r.n_turns and r.n_turns <= 256
        joined[r.conv_id, r.participant] += r.rendered
    for key in joined:
        assert joined[key] == "".join(r.rendered for k, r in sorted(whole.items(), key=lambda x: x[0][2]) if k[:2] == key)
    assert len(got) > len(whole)


def test_256_long_turns_within_the_limit_of_a_value(spark):
    """256 turns of 1 MB would be one value of 256 MB."""
    turns = spark.range(256).selectExpr("1L conv_id", "id turn", "concat('s', id % 2) role", "repeat('0123456789', 100000) text")
    made = chat.rotate(turns).selectExpr("participant", "part", "length(rendered) n", "n_turns").collect()
    assert max(r.n for r in made) < 6_000_000 and sum(r.n_turns for r in made) == 512
