"""Structured Streaming forms: latest job state, tumbling and session windows, and a segment index that grows by micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators import models
from spanloom.operators.chunks import next_windows
from spanloom.sources import store


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    """Job events from Parquet files as they come, with an event time."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


@contextmanager
def _list_states(spark: SparkSession) -> Iterator[None]:
    """Lists, values and timers need the state store that keeps them by key; queries started inside use it."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None, stateful: bool = False) -> DataFrame:
    """Run a stream over all that is there and return what it wrote: Parquet in the shared folder, never rows in the driver. A run
    in the same folder goes on where the last one ended. In complete mode each batch is the whole result and the last one counts. `stateful` streams
    keep lists, values or timers."""
    if stateful:
        with _list_states(stream.sparkSession):
            return drained(stream, mode, folder)
    spark, folder = stream.sparkSession, folder or store.scratch(stream.sparkSession, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        written.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={written[-1]}") if written else spark.createDataFrame([], stream.schema)


def all_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of all events that are there, those still open at the end of the input too: once the stream is drained, a last event far
    in the future moves the watermark past every session. Its own session stays open and is never written."""
    spark, folder = events.sparkSession, store.scratch(events.sparkSession, "sessions")
    last = spark.range(1).select(*[(F.lit("9999-01-01").cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    last.where("false").write.parquet(f"{folder}/last")
    stream = events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/last"))
    drained(sessions(stream, gap, late), folder=folder)
    last.write.mode("append").parquet(f"{folder}/last")
    return drained(sessions(stream, gap, late), folder=folder)


def append_batches(stream: DataFrame, folder: str, checkpoint: str, prepare=lambda df: df) -> None:
    """Index loop: each micro-batch is prepared (embedded) and appended, once, under its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_WINDOW = "media_id long, w_index int, text string, start_ms long, end_ms long, first_seg long, last_seg long"


class _Windows(StatefulProcessor):
    """A medium's open window: its segments are a list that grows by what comes, the last window's span and number a value. A timer closes a medium that falls silent."""

    def __init__(self, limits: tuple, silent_ms: int | None):
        self.limits, self.silent_ms = limits, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seg long, s long, e long, text string")
        self.last = handle.getValueState("last", "s long, e long, n int")

    def _given(self, key, held: list, new: list, closed: bool):
        """Windows that are final now; the state keeps what the next one may begin with."""
        rows = sorted(held + new, key=lambda r: (r[1], r[0]))
        s, e, n = self.last.get() if self.last.exists() else (None, None, 0)
        found, onward, last = next_windows([r[1] for r in rows], [r[2] for r in rows], *self.limits, None if s is None else (s, e), closed)
        if closed:
            self.held.clear()
            self.last.clear()
        else:
            if onward or rows[: len(held)] != held:
                self.held.put(rows[onward:]) if rows[onward:] else self.held.clear()
            elif new:
                self.held.appendList(new)  # nothing was given out, so what is there stays as it is
            if found:
                self.last.update((*map(int, last), n + len(found)))
        out = [(key[0], n + i, " ".join(r[3] for r in rows[a : b + 1]), rows[a][1], rows[b][2], rows[a][0], rows[b][0]) for i, (a, b) in enumerate(found)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _WINDOW.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        closed = bool(new["final"].any())
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not closed:
                self.handle.registerTimer(int(new["ts"].max().timestamp() * 1000) + self.silent_ms)
        new = new[new["text"].notna()]
        fresh = [(int(a), int(b), int(c), d) for a, b, c, d in zip(new["seg_id"], new["start_ms"], new["end_ms"], new["text"])]
        yield from self._given(key, [tuple(r) for r in self.held.get()] if self.held.exists() else [], fresh, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            yield from self._given(key, [tuple(r) for r in self.held.get()], [], True)

    def close(self) -> None:
        pass


def window_stream(segments: DataFrame, target_ms: int = 45_000, overlap: float = 0.5, longest_ms: int = 90_000, shortest_ms: int = 15_000, silent: str | None = None, silent_ms: int = 600_000) -> DataFrame:
    """Windows over a stream of segments (media_id, seg_id, text, start_ms, end_ms, final), each given out once it is filled; a medium's final segment
    (its text may be null) closes it. With `silent`, the delay of the watermark on `ts`, a medium without segments for `silent_ms` is closed by a timer. A segment that is
    late but still in the open window takes its place by time. The state of a medium is its open window. Run it with `drained(..., stateful=True)`."""
    limits = (target_ms, overlap, longest_ms, shortest_ms)
    rows = segments.withWatermark("ts", silent) if silent else segments
    return rows.groupBy("media_id").transformWithStateInPandas(_Windows(limits, silent_ms if silent else None), _WINDOW, "append", "EventTime" if silent else "None")


def index_stream(segments: DataFrame, folder: str, checkpoint: str, factory, **limits) -> None:
    """Segments to windows to vectors to a store, in one query: each micro-batch is embedded and written under its number, so one that runs again after a stop replaces itself. Where
    the embedder fails the vectors are null, and boundaries do without them."""
    vectors = lambda df: df.withColumn("embedding", models.embedded(F.col("text"), factory, tolerant=True))
    with _list_states(segments.sparkSession):
        append_batches(window_stream(segments, **limits), folder, checkpoint, vectors)


class _Tail(StatefulProcessor):
    """What of a job's events one who has a snapshot still has to see: those behind it, up to the first that ends the job."""

    def __init__(self, done: tuple):
        self.done = done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "upto long, ended boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        self.seen.update((int(r["upto"]), bool(r["ended"])))

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        upto, ended = self.seen.get() if self.seen.exists() else (None, False)
        new = new[new["seq"] > upto] if upto is not None else new
        if ended or not len(new):
            return
        stops = np.flatnonzero(new["kind"].isin(self.done))
        new = new.iloc[: stops[0] + 1] if len(stops) else new
        self.seen.update((int(new["seq"].iloc[-1]), bool(len(stops))))
        yield new[["job", "seq", "kind", "value"]]

    def close(self) -> None:
        pass


def tail_stream(history: DataFrame, events: DataFrame, done: tuple = ("done", "error")) -> DataFrame:
    """A stream of jobs' events (job, seq, kind, value) as one sees it who joined with the snapshot of `history`, which is loaded as the state before the first batch; it
    gives nothing of a job any more once an event has ended it. Run it with `drained(..., stateful=True)`."""
    upto = history.groupBy("job").agg(F.max("seq").alias("upto"), F.max(F.col("kind").isin(*done)).alias("ended"))
    kind = lambda c: events.schema[c].dataType.simpleString()
    out = f"job {kind('job')}, seq {kind('seq')}, kind string, value {kind('value')}"
    return events.select("job", "seq", "kind", "value").groupBy("job").transformWithStateInPandas(_Tail(done), out, "append", "None", initialState=upto.groupBy("job"))


def snapshot(history: DataFrame, done: tuple = ("done", "error")) -> DataFrame:
    """The latest row of each kind of a job's events (job, seq, kind, value), up to the first that ends it."""
    ended = history.groupBy("job").agg(F.min(F.when(F.col("kind").isin(*done), F.col("seq"))).alias("ended"))
    state = history.join(ended, "job").where("ended IS NULL OR seq <= ended").groupBy("job", "kind").agg(F.max(F.struct("seq", "value")).alias("x"))
    return state.select("job", "x.seq", "kind", "x.value")


def snapshot_then_tail(history: DataFrame, tail: DataFrame, done: tuple = ("done", "error")) -> DataFrame:
    """What one who joins late sees of jobs' events (job, seq, kind, value): the latest row of each kind, then what came after the snapshot, up to the
    first event that ends a job. Both are read from the same order of seq; `tail` may overlap the history."""
    upto = history.groupBy("job").agg(F.max("seq").alias("upto"), F.min(F.when(F.col("kind").isin(*done), F.col("seq"))).alias("ended"))
    state = history.join(upto, "job").where("ended IS NULL OR seq <= ended").groupBy("job", "kind").agg(F.max(F.struct("seq", "value")).alias("x"))
    first = state.select("job", F.lit("snapshot").alias("part"), "x.seq", "kind", "x.value")
    later = tail.join(upto, "job", "left").where("ended IS NULL AND (upto IS NULL OR seq > upto)")
    ends = later.groupBy("job").agg(F.min(F.when(F.col("kind").isin(*done), F.col("seq"))).alias("stop"))
    rest = later.join(ends, "job").where("stop IS NULL OR seq <= stop")
    return first.unionByName(rest.select("job", F.lit("event").alias("part"), "seq", "kind", "value"))
