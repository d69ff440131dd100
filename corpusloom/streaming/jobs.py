"""Structured Streaming forms of the change queue, debounce, session memory and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import sync

QUEUE_STATE = T.StructType([T.StructField(c, t) for c, t in (("op", T.StringType()), ("remote_id", T.StringType()), ("inflight", T.BooleanType()), ("pending_op", T.StringType()), ("attempt", T.LongType()), ("seq", T.LongType()), ("poisoned", T.BooleanType()))])
QUEUE_OUT = T.StructType([T.StructField("filepath", T.StringType()), *QUEUE_STATE.fields])


def queue_step(state: tuple | None, event: dict, most: int = 7) -> tuple | None:
    """STR-03, STR-05, DML-04: one event (write, claim, ok, fail) on a path's entry. While it is in flight a write goes to
    the pending slot, the newest winning; a success promotes that slot or drops the entry; a failure waits and counts."""
    kind = event["kind"]
    if kind == "write":
        if state is None:
            return (event["op"], event["remote_id"], False, None, 0, event["seq"], False)
        op, remote, inflight, pending, _, _, _ = state
        remote = event["remote_id"] or remote
        return (op, remote, True, event["op"], state[4], event["seq"], False) if inflight else (event["op"], remote, False, pending, 0, event["seq"], False)
    if state is None:
        return None
    op, remote, inflight, pending, attempt, _, poisoned = state
    if kind == "claim":
        return state if inflight or poisoned else (op, remote, True, pending, attempt, event["seq"], False)
    if kind == "ok":
        return None if pending is None else (pending, remote, False, None, 0, event["seq"], False)
    if kind == "fail":
        return (op, remote, False, pending, attempt + 1, event["seq"], attempt + 1 >= most)
    return state


def coalescing_queue(events: DataFrame) -> DataFrame:
    """STR-03: events (filepath, seq, kind, op, remote_id) as updates of the queue's entries; a dropped entry has a null
    op. State is one entry for a path, whatever its events."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        for event in rows.to_dict("records"):
            event = {k: (None if pd.isna(v) else v) for k, v in event.items()}
            own = queue_step(own, event)
        if own is None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], None, None, None, None, None, int(rows.seq.max()), None)], columns=QUEUE_OUT.names)
        else:
            state.update(own)
            yield pd.DataFrame([(key[0], *own)], columns=QUEUE_OUT.names)

    return events.groupBy("filepath").applyInPandasWithState(run, QUEUE_OUT, QUEUE_STATE, "update", GroupStateTimeout.NoTimeout)


def queue_table(events: DataFrame) -> DataFrame:
    """The same over a table: what the queue holds after all events, each path folded in order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = None
        for event in pdf.sort_values("seq").to_dict("records"):
            own = queue_step(own, {k: (None if pd.isna(v) else v) for k, v in event.items()})
        return pd.DataFrame([(pdf.filepath.iloc[0], *own)] if own else [], columns=QUEUE_OUT.names)

    return events.groupBy("filepath").applyInPandas(run, QUEUE_OUT)


def debounce(writes: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """STR-07: a path's burst of writes (filepath, at) as one row once it has been quiet: a session window."""
    return writes.withWatermark("at", late).groupBy("filepath", F.session_window("at", quiet)).agg(F.count("*").alias("writes"), F.max("at").alias("last"))


def once(events: DataFrame, *key: str, within: str = "2 seconds", at: str = "at") -> DataFrame:
    """STR-11: events that repeat a key within a time are dropped."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(list(key))


SESSION_STATE = T.StructType([T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("turns", T.ArrayType(T.LongType()))])
SESSION_OUT = T.StructType([T.StructField("session", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("path", T.StringType()), T.StructField("first_turn", T.LongType())])


def session_memory(hits: DataFrame, window: int) -> DataFrame:
    """STR-13, DLV-07: hits (session, turn, path) with the turn at which each was first shown and is still remembered."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for turn, path in pd.concat(list(batches)).sort_values(["turn", "path"])[["turn", "path"]].drop_duplicates().itertuples(index=False):
            known = {p: t for p, t in known.items() if t > turn - window}
            out.append((key[0], turn, path, known.get(path)))
            known.setdefault(path, turn)
        state.update(([*known], [*known.values()]))
        frame = pd.DataFrame(out, columns=SESSION_OUT.names)
        frame["first_turn"] = frame["first_turn"].astype("Int64")
        yield frame

    return hits.groupBy("session").applyInPandasWithState(run, SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


def pull(stream: DataFrame, apply, checkpoint: str, last_seen: str | None = None):
    """STR-01, STR-02, STR-12, STR-14: each micro-batch's changes after the watermark go to apply(changes, batch_id). A
    checkpoint that is there is a warm start; a cold one takes all. What is recomputed once things have settled is done
    at the end of apply."""
    def batch(changes: DataFrame, number: int) -> None:
        apply(sync.delta(changes, last_seen), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
