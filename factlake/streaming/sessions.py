"""Session state over a stream, with a life cycle: turns, silence, reset, deletion, statistics, forgetting.

A user's state is one value (time of the last turn, number of sessions, turns of this one, turns in all) and
a list of the last HISTORY turns. Two event-time timers bound it: when the watermark passes the end of a
session, its turns go; when it passes FORGET_SECONDS of silence, all of the user's state goes, so what the
store holds follows the users seen lately, not all there ever were. What an event finds does not depend on
when timers fire: the same rules are applied to its distance from the last turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import folder

TTL_SECONDS, FORGET_SECONDS, HISTORY, LATE = 30 * 60, 30 * 24 * 3600, 5, "1 hour"
RESULT = "user_id bigint, event_id bigint, kind string, session_no int, turn_no int, turns bigint, history string, expired boolean"
#: Types of events that are no turns: one takes a user's state away, one asks for it. A reset is a turn that begins a session.
RESET, DELETE, STATS = "reset", "delete", "stats"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SessionProcessor(StatefulProcessor):
    """A user's events in order. More than `ttl` seconds of silence, or a reset, begins a new session; more
    than `forget` seconds, or a deletion, and sessions are counted from one again."""

    def __init__(self, ttl: int = TTL_SECONDS, forget: int = FORGET_SECONDS):
        self.ttl, self.forget = ttl * 1_000_000, forget * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, session int, turn int, turns bigint")
        self.recent = handle.getListState("recent", "event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, session, turn, turns = self.seen.get() if self.seen.exists() else (None, 0, 0, 0)
        history = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a user's part of one micro-batch
        out = []
        for at, event, kind in zip(events["at"].tolist(), events["event_id"].tolist(), events["event_type"].tolist(), strict=True):
            if last is not None and at - last > self.forget:
                last, session, turn, turns, history = None, 0, 0, 0, []
            expired = last is not None and at - last > self.ttl
            if kind == STATS:
                known = ([] if expired else history), (0 if expired else turn)
                out.append((event, "stats", session, known[1], turns, ",".join(known[0]), expired))
                continue
            if kind == DELETE:
                out.append((event, "deleted", session, 0 if expired else turn, turns, "", expired))
                last, session, turn, turns, history = None, 0, 0, 0, []
                continue
            if last is None or expired or kind == RESET:
                session, turn, history = session + 1, 0, []
            turn, turns, last = turn + 1, turns + 1, at
            history = [*history, "" if kind is None else kind][-HISTORY:]
            out.append((event, "turn", session, turn, turns, ",".join(history), expired))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is None:
            self.seen.clear()
            self.recent.clear()
        else:
            self.seen.update((last, session, turn, turns))
            self.recent.put([(h,) for h in history])
            for silence in (self.ttl, self.forget):
                self.handle.registerTimer(max((last + silence) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        frame = pd.DataFrame(out, columns=["event_id", "kind", "session_no", "turn_no", "turns", "history", "expired"])
        frame.insert(0, "user_id", key[0])
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            last, session, _, turns = self.seen.get()
            self.recent.clear()
            if expiredTimerInfo.getExpiryTimeInMs() * 1000 > last + self.forget:
                self.seen.clear()
            else:
                self.seen.update((last, session, 0, turns))
        yield from ()

    def close(self) -> None:
        pass


def session_states(events: DataFrame, ttl: int = TTL_SECONDS, forget: int = FORGET_SECONDS) -> DataFrame:
    """events (a stream: user_id, event_id, ts, event_type) to what each finds: RESULT. Events more than LATE
    behind the latest of earlier batches are left out, as are those without a user or a time."""
    rows = events.where("user_id is not null and ts is not null").withWatermark("ts", LATE)
    rows = rows.select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(SessionProcessor(ttl, forget), RESULT, "Append", "EventTime")


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that a watermark has closed, by Spark's own session windows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with several columns needs the store that has column families; settings stay as they were."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what there is and returns all that it has written beneath the folder, in this run
    and in earlier ones: with the same folder it goes on where it stopped."""
    path = path.rstrip("/")
    with _rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """user_id, last, session_no, turn_no, turns of every user whose state a drained stream's store holds."""
    state = spark.read.format("statestore").option("path", f"{path.rstrip('/')}/state").option("stateVarName", "seen").load()
    return state.select("key.user_id", F.timestamp_micros("value.last").alias("last"), F.col("value.session").alias("session_no"), F.col("value.turn").alias("turn_no"), F.col("value.turns").alias("turns"))


def statistics(stored: DataFrame) -> DataFrame:
    """users, active_sessions, turns of stored_sessions()."""
    return stored.agg(F.count("*").alias("users"), F.count_if(F.col("turn_no") > 0).alias("active_sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))


def _event_stream(spark: SparkSession, sf_dir: str, event_type) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a file or a folder of files
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), event_type.alias("event_type"))


def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, to the end."""
    states = session_states(_event_stream(spark, sf_dir, F.col("event_type")))
    return drain(states, f"{folder(spark)}/stream-{uuid.uuid4().hex}").select("user_id", "event_id", "session_no", "turn_no", "history", "expired")


def stream_session_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with resets, deletions and questions for statistics among the events, and users forgotten
    after two days."""
    k = F.col("event_id")
    control = F.when(k % 37 == 0, DELETE).when(k % 17 == 0, RESET).when(k % 23 == 0, STATS).otherwise(F.col("event_type"))
    states = session_states(_event_stream(spark, sf_dir, control), ttl=6 * 3600, forget=2 * 24 * 3600)
    return drain(states, f"{folder(spark)}/stream-{uuid.uuid4().hex}")
