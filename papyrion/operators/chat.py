"""Conversations as an append-only log, and their state by query.

A log has (session_id, seq, kind, conv_id). Kinds: ``message``, ``error``, ``save``
(puts the conversation into the history, or overwrites its place there), ``load``
(saves the conversation that is current, if any, and makes one of the history the current one; a load of one that is not
there does nothing), ``new`` and ``ingest`` (a new chat,
or a new file: save the conversation they name, if any, and then nothing is current),
``discard`` (nothing is current; what was saved stays), ``delete`` (takes one out of the
history), ``clear`` (empties it).

A chat that was never saved has no name, so it is not current in this sense: its client logs a save before the load.

The history is aggregated from the log before it is shuffled; positions in it
come from a global order of its rows. So a session with a third of all events is
spread over the tasks.

Defined results: events of a null session or conversation are carried as those of
one null session or conversation; repeated events change nothing but counts; an
empty log has no sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import title
from papyrion.operators.order import anchored, in_order, numbered
from papyrion.session import stage

ERROR_PREFIX = "Error:"


def _saves():
    """Events that put the conversation they name into the history."""
    return (F.col("kind") == "save") | (F.col("kind").isin("new", "ingest") & F.col("conv_id").isNotNull())


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, is_error) in the order of turns."""
    failed = (F.col("role") == "assistant") & F.coalesce(F.col("text").startswith(ERROR_PREFIX), F.lit(False))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("content"), failed.alias("is_error"))


def titles(turns: DataFrame) -> DataFrame:
    """By conversation: ``title`` of the first turn, ``user_title`` of the first turn of a user, and ``error_title``, which a failed save gives."""
    first = lambda kept: F.min_by("text", F.when(kept, F.col("turn")))
    made = turns.groupBy("conv_id").agg(first(F.lit(True)).alias("t"), first(F.col("role") == "user").alias("u"))
    return made.select("conv_id", title(F.col("t")).alias("title"), title(F.col("u")).alias("user_title"), title(F.col("t"), always=True).alias("error_title"))


def snapshots(turns: DataFrame) -> DataFrame:
    """By conversation: what a save would hold, without its texts, which stay in the log."""
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        title(F.min_by("text", "turn")).alias("title"),
        F.max_by("role", "turn").alias("last_role"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def saved_conversations(turns: DataFrame, log: DataFrame) -> DataFrame:
    """(session_id, conv_id, saved_at, title, messages): each conversation of the history, as it is kept.

    ``log`` also has ``ts``; ``saved_at`` is that of the last save. ``messages`` is an array of
    (role, content) in the order of turns; a conversation that has no turns has nothing to save.
    """
    last = history(log).select("session_id", "conv_id", F.col("last_seq").alias("seq"))
    times = log.groupBy("session_id", "conv_id", "seq").agg(F.max("ts").alias("saved_at"))
    at = _join(last, times, ["session_id", "conv_id", "seq"], "left").drop("seq")
    # A conversation is gathered as one row by definition, and once for all sessions that have it.
    wanted = turns.join(at.select("conv_id").distinct(), "conv_id", "left_semi")
    whole = wanted.groupBy("conv_id").agg(
        title(F.min_by("text", "turn")).alias("title"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages"),
    )
    return at.join(whole, "conv_id").select("session_id", "conv_id", "saved_at", "title", "messages")


def load(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The messages of the conversations in ``wanted`` (conv_id); one that does not exist gives nothing."""
    return messages(turns.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi"))


def with_last_clear(log: DataFrame) -> DataFrame:
    """The log with ``last_clear``, the seq of the session's last clear before each event, or null."""
    order = [F.col(c).asc_nulls_first() for c in ("session_id", "seq")]
    placed = numbered(in_order(log, *order), "session_id", "chat-log")
    clear = F.col("kind") == "clear"
    marked = anchored(placed, clear, "__place")
    clears = placed.where(clear).select(F.col("place").alias("__place"), F.col("seq").alias("last_clear"))
    return marked.join(clears, "__place", "left").select(*log.columns, "last_clear")


def history(log: DataFrame, by_loads: bool = True) -> DataFrame:
    """(session_id, conv_id, first_seq, last_seq): saved conversations that are still there.

    ``last_seq`` is that of the last save, also one that a load began with, unless ``by_loads`` is false, which saves finding those.
    """
    by = ["session_id", "conv_id"]
    gone = log.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "clear", F.col("seq"))).alias("cleared"))
    deleted = log.where("kind = 'delete'").groupBy(*by).agg(F.max("seq").alias("deleted"))
    put = log.where(_saves()).select(*by, "seq")
    # A conversation that a load saves is in the history, so its first save is another one.
    saves = (put.unionByName(saved_by_loads(log)) if by_loads else put).groupBy(*by, "seq").agg(F.lit(1).alias("one"))
    same = lambda other, names: [F.col(n).eqNullSafe(other[f"__{n}"]) for n in names]
    renamed = lambda df, names: df.withColumnsRenamed({n: f"__{n}" for n in names})
    d, g = renamed(deleted, by), renamed(gone, by[:1])
    joined = saves.join(d, same(d, by), "left").join(g, same(g, by[:1]), "left")
    since = F.greatest(F.col("deleted"), F.col("cleared"))
    alive = joined.where(since.isNull() | (F.col("seq") > since))
    return alive.groupBy(*by).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def saved_by_loads(log: DataFrame) -> DataFrame:
    """(session_id, conv_id, seq): the conversation that is current when another is loaded, and when that is."""
    ends = log.where("kind in ('new', 'ingest', 'discard', 'clear')").select("session_id", "seq", "conv_id", F.lit("end").alias("what"))
    deletes = log.where("kind = 'delete'").select("session_id", "seq", "conv_id", F.lit("delete").alias("what"))
    sets = settings(log).select("session_id", "seq", "conv_id", F.col("kind").alias("what"))
    marks = sets.unionByName(ends).unionByName(deletes)
    placed = numbered(in_order(marks, *[F.col(c).asc_nulls_first() for c in ("session_id", "seq")]), "session_id", "current-log")
    is_set = F.col("what").isin("save", "load")
    # What was set or ended last before each mark: the row before says it, if it is of the same session.
    before = anchored(placed, is_set | (F.col("what") == "end"), "__anchor").select((F.col("place") + 1).alias("__next"), "__anchor")
    behind = placed.where(F.col("place") > F.col("first_place")).join(before, F.col("place") == F.col("__next"))
    now = placed.where(is_set).select(F.col("place").alias("__set"), F.col("conv_id").alias("now"))
    known = behind.where("what in ('load', 'delete')").join(now, F.col("__anchor") == F.col("__set")).select("session_id", "seq", "conv_id", "what", "__set", "now")
    known = stage(known, "loads-and-deletes")
    # A delete of what is current ends it, up to the next set.
    ended = known.where("what = 'delete'").where(F.col("conv_id").eqNullSafe(F.col("now"))).groupBy(F.col("__set").alias("__of")).agg(F.min("seq").alias("ended"))
    loads = known.where("what = 'load'").join(ended, F.col("__set") == F.col("__of"), "left")
    return loads.where(F.col("ended").isNull() | (F.col("ended") > F.col("seq"))).select("session_id", F.col("now").alias("conv_id"), "seq")


def positions(saved: DataFrame) -> DataFrame:
    """The history with ``position`` in its session, from 0, as the list of saves would have it."""
    order = [F.col(c).asc_nulls_first() for c in ("session_id", "first_seq", "conv_id")]
    placed = numbered(in_order(saved, *order), "session_id", "history")
    return placed.select(*saved.columns, (F.col("place") - F.col("first_place")).alias("position"), F.col("batch_rows").alias("n_saved"))


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equal in ``names``, where null equals null: the events of a null session are those of one session."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    return left.join(other, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], how).drop(*[f"__{n}" for n in names])


def settings(log: DataFrame) -> DataFrame:
    """The events that make a conversation the current one: saves, and loads of what is in the history."""
    known = with_last_clear(log).where("kind in ('save', 'load', 'delete', 'new', 'ingest')")
    # In the order of each conversation's events, the last save or delete says whether it is in the history.
    name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "conv_id")])
    order = [F.col(c).asc_nulls_first() for c in ("session_id", "conv_id", "seq")]
    placed = numbered(in_order(known.withColumn("of", name), *order), "of", "conversation-log")
    marked = anchored(placed, _saves() | (F.col("kind") == "delete"), "__place")
    puts = placed.where(_saves()).select(F.col("place").alias("__place"), F.col("seq").alias("saved"))
    seen = marked.join(puts, "__place", "left")
    there = F.col("saved").isNotNull() & (F.coalesce("last_clear", F.lit(-1)) < F.col("saved"))
    return seen.where("kind in ('save', 'load')").where(there).select("session_id", "seq", "conv_id", "kind")


def standing(log: DataFrame) -> DataFrame:
    """(session_id, n_messages, n_saved, conv_id): what is left of each session in the end, by aggregates alone.

    What a session ends on is its last save, or a load behind it and behind all that ends a conversation. No save comes
    behind such a load, so the last save of the loaded conversation, and the first delete behind that, say whether it was in
    the history. Rows are combined before each shuffle; raw deletes and loads meet one row of their conversation, on the side
    of a join that adaptive execution can split.
    """
    by = ["session_id", "conv_id"]
    kind, seq = F.col("kind"), F.col("seq")
    last = lambda of: F.max(F.when(of, seq))
    about = log.groupBy("session_id").agg(
        F.count_if(kind == "message").alias("n_messages"),
        last(kind == "clear").alias("cleared"),
        last(kind.isin("new", "ingest", "discard", "clear")).alias("ended"),
        last(kind == "save").alias("saved"),
    )
    behind = lambda x, y: y.isNull() | (x > y)
    put = log.where(_saves()).groupBy(*by).agg(F.max("seq").alias("put"))
    kept = _join(put, about.drop("n_messages"), by[:1]).where(behind(F.col("put"), F.col("cleared")))
    deleted = _join(log.where("kind = 'delete'").select(*by, "seq"), kept.select(*by, "put"), by).where("seq > put")
    # Written, as the loads and the sum by session both read it.
    known = stage(_join(kept, deleted.groupBy(*by).agg(F.min("seq").alias("gone")), by, "left"), "chat-history")
    floor = F.greatest("ended", "saved").alias("floor")
    loads = _join(log.where("kind = 'load'").select(*by, "seq"), known.select(*by, "gone", floor), by)
    loads = loads.where(behind(seq, F.col("floor")) & (F.col("gone").isNull() | (seq < F.col("gone"))))
    found = _join(known, loads.groupBy(*by).agg(F.max("seq").alias("loaded")), by, "left")
    at = F.greatest(F.when((F.col("put") == F.col("saved")) & behind(F.col("saved"), F.col("ended")), F.col("put")), "loaded")
    ends_on = found.groupBy("session_id").agg(F.count_if(F.col("gone").isNull()).alias("n_saved"), F.max_by(F.struct("conv_id", "gone"), at).alias("on"))
    now = F.when(F.col("on.gone").isNull(), F.col("on.conv_id"))
    return _join(about.select("session_id", "n_messages"), ends_on, by[:1], "left").select(
        "session_id", "n_messages", F.coalesce("n_saved", F.lit(0)).alias("n_saved"), now.alias("conv_id"), (F.col("on").isNotNull() & F.col("on.gone").isNull()).alias("is_on")
    )


def current(log: DataFrame) -> DataFrame:
    """(session_id, conv_id): the current conversation of each session that has one.

    A save makes its conversation the current one, as does a load of one that is in the history.
    """
    return standing(log).where("is_on").select("session_id", "conv_id")


def recent(saved: DataFrame, n: int = 5, now: DataFrame | None = None) -> DataFrame:
    """The last ``n`` of each session's history, oldest first in ``shown``, with the number of all.

    With ``now``, as `current` gives it, ``is_current`` marks the current conversation.
    """
    totals = saved.groupBy("session_id").agg(F.count("*").alias("n_saved"))
    back = Window.partitionBy("session_id").orderBy(F.desc("first_seq"), F.desc("conv_id"))
    last = saved.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    joined = _join(last, totals, ["session_id"])
    shown = joined.select("session_id", "conv_id", (F.least(F.lit(n), "n_saved") - F.col("back") + 1).alias("shown"), "n_saved")
    if now is None:
        return shown
    marked = _join(shown, now.withColumn("is_current", F.lit(True)), ["session_id", "conv_id"], "left")
    return marked.withColumn("is_current", F.coalesce("is_current", F.lit(False)))


def errors(log: DataFrame) -> DataFrame:
    """By session: errors, and those after its last save, which no save holds yet."""
    last = log.groupBy("session_id").agg(F.max(F.when(_saves(), F.col("seq"))).alias("saved"))
    failed = _join(log.where("kind = 'error'").select("session_id", "seq"), last, ["session_id"])
    return failed.groupBy("session_id").agg(
        F.count("*").alias("n_errors"), F.count_if(F.col("saved").isNull() | (F.col("seq") > F.col("saved"))).alias("n_unsaved")
    )


def state(log: DataFrame) -> DataFrame:
    """By session: messages, size of the history, current conversation (or null)."""
    return standing(log).drop("is_on")
