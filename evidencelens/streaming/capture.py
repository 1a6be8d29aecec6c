"""Capture lifecycle as Structured Streaming, with batch twins that must agree."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The helpers below travel with the task, so executors need NumPy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_US = 60_000_000
GAP = "2 minutes"

RECORD = "event_id long, record string, ref string, reason string, n_actions long, outcome boolean"


def assemble_episodes(events: DataFrame, time: str = "ts", gap: str = GAP) -> DataFrame:
    """One row per episode plus one per rejected row, from a batch or a watermarked stream alike.

    ``events``: event_id, kind (start/action/outcome), ref, flag and the event time. Rows of one event
    form a session; actions and outcomes count within [start, start + 60 s], the first outcome closes the
    episode. The gap exceeds the 60 s window, so a row that comes too late for its episode still meets its
    start and is reported; a row in a session of its own has no start and is rejected as such. The list held
    per session is what one person did in about a minute.
    """
    row = F.struct(F.unix_micros(time).alias("us"), "ref", "kind", "flag")
    g = events.groupBy("event_id", F.session_window(time, gap)).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.array_min(F.transform(F.filter("rows", lambda r: r["kind"] == "start"), lambda r: r["us"]))
    g = g.select("event_id", start.alias("start_us"), F.filter("rows", lambda r: r["kind"] != "start").alias("rows"))
    inside = lambda r: F.coalesce((r["us"] - F.col("start_us")).between(0, WINDOW_US), F.lit(False))
    g = g.withColumn("first", F.get(F.filter("rows", lambda r: inside(r) & (r["kind"] == "outcome")), F.lit(0)))
    none = lambda t: F.lit(None).cast(t)

    def out(record: str, ref: Column, reason: Column, n: Column, outcome: Column) -> Column:
        return F.struct(F.lit(record).alias("record"), ref.alias("ref"), reason.alias("reason"), n.cast("long").alias("n_actions"), outcome.alias("outcome"))

    taken = F.size(F.filter("rows", lambda r: inside(r) & (r["kind"] == "action")))
    episode = F.when(F.col("start_us").isNotNull(), out("episode", F.col("first.ref"), none("string"), taken, F.col("first.flag")))
    again = lambda r: (r["kind"] == "outcome") & ((r["us"] != F.col("first.us")) | (r["ref"] != F.col("first.ref")))
    reason = lambda r: F.when(F.col("start_us").isNull(), "no_start").when(~inside(r), "outside_window").when(again(r), "already_finalized")
    rejected = F.filter(F.transform("rows", lambda r: out("rejected", r["ref"], reason(r), none("long"), none("boolean"))), lambda x: x["reason"].isNotNull())
    every = F.concat(F.array_compact(F.array(episode)), rejected)
    return g.select("event_id", F.explode(every).alias("o")).select("event_id", "o.*")


def assemble_episodes_stream(events: DataFrame, time: str = "ts", delay: str = "2 minutes", gap: str = GAP) -> DataFrame:
    """The same over a stream: a session is emitted once the watermark has passed its end."""
    return assemble_episodes(events.withWatermark(time, delay), time, gap)


#: What a slot of event ids keeps: started events, and rows whose start has not come.
EVENTS = pa.schema([("event_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("closed", pa.bool_()), ("has", pa.bool_()), ("us", pa.int64()), ("ref", pa.string()), ("flag", pa.bool_())])
EARLY = pa.schema([("event_id", pa.int64()), ("us", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("flag", pa.bool_())])


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    table = pa.ipc.open_stream(data).read_all() if data else schema.empty_table()
    return table.to_pandas().astype({"ref": object, "flag": object})


def _answers(rows: pd.DataFrame, reason: str) -> pd.DataFrame:
    return pd.DataFrame({"event_id": rows["event_id"], "record": "rejected", "ref": rows["ref"], "reason": reason, "n_actions": None, "outcome": None})


def _judged(events: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
    """Started events after further rows of theirs, and the rows that are rejected."""
    met = rows.merge(events[["event_id", "start"]], on="event_id")
    inside = (met["us"] - met["start"]).between(0, WINDOW_US)
    out, met = [_answers(met[~inside], "outside_window")], met[inside]
    taken = met.loc[met["kind"] == "action", "event_id"].value_counts()
    events = events.assign(n=events["n"] + events["event_id"].map(taken).fillna(0).astype("int64"))
    came = met.loc[met["kind"] != "action", ["event_id", "us", "ref", "flag"]]
    held = events.loc[events["has"] & events["event_id"].isin(came["event_id"]), came.columns]
    every = pd.concat([held, came])
    every["place"] = every["ref"].fillna("")
    every = every.sort_values(["event_id", "us", "place"])
    first = every.drop_duplicates("event_id")
    again = every.merge(first[["event_id", "us", "place"]], on="event_id", suffixes=("", "_first"))
    out.append(_answers(again[(again["us"] != again["us_first"]) | (again["place"] != again["place_first"])], "already_finalized"))
    changed = events["event_id"].isin(first["event_id"])
    best = first.assign(has=True).merge(events.loc[changed, ["event_id", "start", "n", "closed"]], on="event_id")
    return pd.concat([events[~changed], best[EVENTS.names]], ignore_index=True), out


def assemble_episodes_state(events: DataFrame, time: str = "ts", delay: str = "2 minutes", keep_us: int = 2 * WINDOW_US, slots: int = 1024) -> DataFrame:
    """:func:`assemble_episodes` with keyed state and timers instead of a list a session.

    Event ids are dealt over ``slots`` by a hash. A slot keeps one value: its open events (start, number of actions, first outcome so far) and the
    rows that came before their start, so the calls to the state store grow with the slots, not with the events. One timer a slot stands at its
    earliest deadline. An episode is closed once the watermark has passed start + 60 s; rows that the state can judge are answered at once
    (outside the window, another outcome than the first), and the event is forgotten ``keep_us`` after its start at the earliest. A row whose
    start does not come within ``keep_us`` is rejected. Of several starts the first to arrive counts. A slot's new rows of one batch are in
    memory at once: choose ``slots`` by the rows of a batch.
    """

    class Episodes(StatefulProcessor):
        """One value a slot: the packed events and early rows, and the time of the pending timer."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", "events binary, early binary, due long")

        def load(self) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
            kept = self.kept.get() or (None, None, None)
            return _unpacked(kept[0], EVENTS), _unpacked(kept[1], EARLY), kept[2]

        def deadlines(self, events: pd.DataFrame, early: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
            """The watermark in ms from which an event closes or is forgotten, and an early row is rejected."""
            until = events["start"] + np.where(events["closed"].astype(bool), keep_us, WINDOW_US)
            return until // 1000 + 1, (early["us"] + keep_us) // 1000 + 1

        def save(self, events: pd.DataFrame, early: pd.DataFrame, due: int | None) -> None:
            if events.empty and early.empty:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.kept.clear()
                return
            soonest = int(min(d.min() for d in self.deadlines(events, early) if len(d)))
            if due is None or soonest < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(soonest)
                due = soonest
            self.kept.update((_packed(events, EVENTS), _packed(early, EARLY), due))

        def shown(self, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [p for p in parts if len(p)]
            if parts:
                yield pd.concat([p.astype({"ref": object, "reason": object, "n_actions": "Int64", "outcome": "boolean"}) for p in parts], ignore_index=True)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            events, early, due = self.load()
            came = pd.concat([r[EARLY.names].astype({"ref": object, "flag": object}) for r in rows], ignore_index=True)
            opens = came["kind"] == "start"
            starts = came[opens & ~came["event_id"].isin(events["event_id"])].groupby("event_id", as_index=False)["us"].min().rename(columns={"us": "start"})
            events = pd.concat([events, starts.assign(n=0, closed=False, has=False, us=0, ref=None, flag=None)], ignore_index=True) if len(starts) else events
            waiting = pd.concat([early, came[~opens]], ignore_index=True) if len(early) else came[~opens]
            started = waiting["event_id"].isin(events["event_id"])
            events, out = _judged(events, waiting[started])
            self.save(events, waiting[~started], due)
            yield from self.shown(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            events, early, _ = self.load()
            at, early_at = self.deadlines(events, early)
            done = events[(at <= now) & ~events["closed"].astype(bool)]
            episodes = pd.DataFrame({"event_id": done["event_id"], "record": "episode", "ref": done["ref"], "reason": None, "n_actions": done["n"], "outcome": done["flag"]})
            out = [episodes, _answers(early[early_at <= now], "no_start")]
            events = events.assign(closed=events["closed"].astype(bool) | (at <= now))
            gone = events["closed"] & (self.deadlines(events, early)[0] <= now)
            self.save(events[~gone], early[early_at > now], None)
            yield from self.shown(out)

        def close(self) -> None:
            pass

    rows = events.withWatermark(time, delay).select(F.pmod(F.xxhash64("event_id"), F.lit(slots)).alias("slot"), "event_id", F.unix_micros(time).alias("us"), "kind", "ref", "flag", time)
    return rows.groupBy("slot").transformWithStateInPandas(Episodes(), RECORD, "append", "eventTime")


def _stepped(sequence: int, pdf: pd.DataFrame, gate: str, last: int, was: str) -> tuple[tuple[int, str], pd.DataFrame]:
    """((last frame, its state), rows) of a sequence's further frames."""
    pdf = pdf.sort_values("frame_index", kind="stable")
    frame, ok = pdf["frame_index"].to_numpy(), pdf[gate].to_numpy(bool)
    fresh = frame > np.maximum(np.concatenate(([last], frame[:-1])), last)
    seen = ok[fresh]
    before = np.concatenate(([was == "target"], seen))[: len(seen)]
    out = pd.DataFrame({"sequence_id": sequence, "frame_index": frame, "state": None, "transition": "late"})
    out.loc[fresh, "state"] = np.where(seen, "target", "lost")
    out.loc[fresh, "transition"] = np.where(seen, np.where(before, "tracked", "reacquired"), np.where(before, "lost", "remain_lost"))
    if len(seen):
        last, was = int(frame[fresh][-1]), "target" if seen[-1] else "lost"
    return (int(last), was), out


def track_state_expiring(frames: DataFrame, gate: str = "accepted", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """:func:`track_state_stream` whose sequences are forgotten after ``idle`` without a frame: a later frame starts the sequence anew."""
    out = "sequence_id long, frame_index long, state string, transition string"

    class Track(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "frame long, state string", int(idle.total_seconds() * 1000))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame, was = tuple(self.last.get()) if self.last.exists() else (-1, "target")
            (frame, was), shown = _stepped(key[0], pd.concat(list(rows)), gate, frame, was)
            self.last.update((frame, was))
            yield shown

        def close(self) -> None:
            pass

    return frames.select("sequence_id", "frame_index", gate).groupBy("sequence_id").transformWithStateInPandas(Track(), out, "append", "processingTime")


def track_state_stream(frames: DataFrame, gate: str = "accepted") -> DataFrame:
    """Target state over an unbounded frame stream; state is (last frame, last state) per sequence.

    A frame at or before the last index is reported as ``late`` and changes nothing.
    """
    out = "sequence_id long, frame_index long, state string, transition string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, was = state.get if state.exists else (-1, "target")
        now, shown = _stepped(key[0], pd.concat(list(batches)), gate, last, was)
        state.update(now)
        yield shown

    return frames.select("sequence_id", "frame_index", gate).groupBy("sequence_id").applyInPandasWithState(step, out, "last_frame long, state string", "append", GroupStateTimeout.NoTimeout)


def capture_status_stream(records: DataFrame, time: str = "ts", delay: str = "1 hour", window: str = "1 day", key: str = "household_id") -> DataFrame:
    """Capture counts per key and tumbling window, appended once the watermark closes the window."""
    ready = F.col("finalized") & F.col("valid")
    g = records.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("finalized").alias("finalized_records"), F.count_if(ready).alias("ready"), F.count_if(~F.col("valid")).alias("invalid"),
        *[F.count_if(ready & (F.col("outcome_state") == s)).alias(s) for s in ("terminated", "continued", "unknown")])
    return g.select(F.col("window.start").alias("window_start"), key, "records", "finalized_records", "ready", "invalid", "terminated", "continued", "unknown")


#: State with timers and expiry is kept by this provider.
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Expiry by the clock asks for another batch without rows again and again; a bounded run does without.
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def timed_state(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """A session in which streams with timers can start; the settings are put back."""
    wanted = {STATE_PROVIDER[0]: STATE_PROVIDER[1], IDLE_BATCHES: str(idle_batches).lower()}
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over all available input into parquet files and stops."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
