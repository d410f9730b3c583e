"""Chat sessions as a stream: the state of `operators.chat`, kept event by event as the log grows.

Each session has its messages, its current conversation and its history in Spark's state store; a micro-batch reads only
the events that are new. Events must come in the order of their ``seq`` from one micro-batch to the next, as those of an
append-only log do; inside a micro-batch they may come in any order. A session is worked on by one task at a time, which holds
its new events only: how many those are is bounded by what a micro-batch takes (``maxFilesPerTrigger`` and such).

Defined results: those of `operators.chat`; a null session is a session, and a null conversation a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session gives in each micro-batch that has events of it; ``upto`` is the last of them.
STATE = "session_id long, n_messages long, n_saved long, conv_id long, upto long"
#: The store that keeps what the sessions have in several kinds of state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Session(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # Conversations by name, where null has a name of its own; (messages, saved, current or null, is one current?)
        self.history = handle.getMapState("history", "name string", "first_seq long, last_seq long")
        self.about = handle.getValueState("about", "n_messages long, n_saved long, now string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n_messages, n_saved, now = self.about.get() if self.about.exists() else (0, 0, None)
        names = ["" if pd.isna(c) else str(int(c)) for c in events["conv_id"]]

        def put(name: str, seq: int) -> int:
            """Saves a conversation; 1 if it is new."""
            known = (name,)
            first = self.history.getValue(known)[0] if self.history.containsKey(known) else None
            self.history.updateValue(known, (seq if first is None else first, seq))
            return int(first is None)

        for kind, seq, name in zip(events["kind"], events["seq"].astype(int).tolist(), names):
            if kind == "message":
                n_messages += 1
            elif kind == "save" or kind in ("new", "ingest") and name:
                n_saved += put(name, seq)
                now = name
            elif kind == "load" and self.history.containsKey((name,)):
                if now is not None:
                    put(now, seq)
                now = name
            elif kind == "delete" and self.history.containsKey((name,)):
                self.history.removeKey((name,))
                n_saved -= 1
                now = None if now == name else now
            elif kind == "clear":
                self.history.clear()
                n_saved, now = 0, None
            if kind in ("new", "ingest", "discard"):
                now = None
        self.about.update((int(n_messages), int(n_saved), now))
        yield pd.DataFrame(
            {
                "session_id": pd.array([None if key[1] else key[0]], "Int64"),
                "n_messages": [int(n_messages)],
                "n_saved": [int(n_saved)],
                "conv_id": pd.array([int(now) if now else None], "Int64"),
                "upto": [int(events["seq"].max())],
            }
        )

    def close(self) -> None:
        pass


def session_states(log: DataFrame) -> DataFrame:
    """A stream of (session_id, n_messages, n_saved, conv_id, upto) for a stream of events (session_id, seq, kind, conv_id).

    Needs a session whose ``spark.sql.streaming.stateStore.providerClass`` is `STORE`.
    """
    chosen = log.select(F.coalesce("session_id", F.lit(0)).cast("long").alias("k"), F.col("session_id").isNull().alias("none"), "seq", "kind", F.col("conv_id").cast("long").alias("conv_id"))
    return chosen.groupBy("k", "none").transformWithStateInPandas(_Session(), STATE, "Update", "None")


def follow(log: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the states of each micro-batch to a table at ``path``; `latest` reads it. A micro-batch that runs again overwrites its own rows."""

    def take(states: DataFrame, number: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = session_states(log).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(states: DataFrame) -> DataFrame:
    """(session_id, n_messages, n_saved, conv_id): the last state of each session in a table that `follow` wrote."""
    last = states.groupBy("session_id").agg(F.max_by(F.struct("n_messages", "n_saved", "conv_id"), "batch").alias("s"))
    return last.select("session_id", "s.*")
