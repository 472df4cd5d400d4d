"""Streams with state by key: the rate limiter and pointer strokes, on value and list state with event-time timers.

A micro-batch reads and writes the state of its own keys alone. A timer, set behind what a key may still need,
removes its state once the watermark has passed it. Rows of a key count in their own order inside a micro-batch, and micro-batches in
theirs; of a key's rows only the few numbers that decide are held while they are put in order, and the source's limits
(``maxFilesPerTrigger`` and the like) bound a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vellumspark.operators.limiter import DECISIONS, MOST, WINDOW, decide

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds by which rows may lag behind the latest ones, and a pointer may rest inside a stroke.
LATENESS, REST = 86_400_000_000, 60_000_000


def drained(rows: DataFrame, processor: StatefulProcessor, key: str, schema: str, path: str, checkpoint: str) -> DataFrame:
    """Run ``rows`` through ``processor`` until all that the source has is read; its rows are written under ``path`` and read back.

    A run that is started again with the same ``checkpoint`` goes on where the last one ended. The session's state store is set for the run alone.
    """
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        out = rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(schema).parquet(path)


class Limiter(StatefulProcessor):
    """State of a client: the end of its window in microseconds, and how many requests that has seen."""

    def __init__(self, window: int, most: int, lateness: int):
        self.window, self.most, self.lateness = window, most, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "reset long, count long")

    def timer(self, reset: int) -> int:
        return (reset + self.lateness) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, ts = zip(*((r["id"].to_numpy(np.int64), r["micros"].to_numpy(np.int64)) for r in rows))
        ids, ts = np.concatenate(ids), np.concatenate(ts)
        order = np.lexsort((ids, ts))
        ids, ts = ids[order], ts[order]
        before = self.state.get() if self.state.exists() else (None, 0)
        counts, resets, reset, count = decide(ts, self.window, self.most, before[0], before[1])
        self.state.update((int(reset), int(count)))
        if before[0] != reset:
            if before[0] is not None:
                self.handle.deleteTimer(self.timer(before[0]))
            self.handle.registerTimer(self.timer(int(reset)))
        at = lambda micros: pd.to_datetime(micros, unit="us", utc=True)
        yield pd.DataFrame({"client": key[0], "id": ids, "ts": at(ts), "allowed": counts <= self.most, "remaining": np.maximum(0, self.most - counts).astype(np.int32), "reset": at(resets)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.timer(self.state.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, path: str, checkpoint: str, window: int = WINDOW, most: int = MOST, lateness: int = LATENESS) -> DataFrame:
    """(client, id, ts, allowed, remaining, reset): what ``limited`` decides, for a stream of requests (client, id, ts) in any
    cut into micro-batches, each counted by time and then id. Requests more than ``lateness`` behind the latest are dropped by the
    watermark; a client's state goes that long after its window has ended. Rows without a client or a time are left out."""
    rows = requests.select(F.col("client").cast("long"), F.col("id").cast("long"), F.col("ts").cast("timestamp")).where("client is not null and ts is not null")
    rows = rows.withWatermark("ts", f"{lateness // 1000} milliseconds").withColumn("micros", F.unix_micros("ts"))
    return drained(rows, Limiter(window, most, lateness), "client", DECISIONS, path, checkpoint)


POINTS = "array<struct<seq:bigint,x:double,y:double,pressure:double>>"


class Strokes(StatefulProcessor):
    """State of a user: the number of its last stroke, whether that is open, and the open stroke's points so far."""

    def __init__(self, rest: int):
        self.rest = rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stroke = handle.getValueState("stroke", "id long, open boolean, timer long")
        self.points = handle.getListState("points", "seq long, x double, y double, pressure double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, open_, timer = self.stroke.get() if self.stroke.exists() else (0, False, None)
        frame = pd.concat([r[["seq", "down", "up", "x", "y", "pressure", "millis"]] for r in rows]).sort_values("seq")
        done, fresh, latest = [], [], 0
        for seq, down, up, x, y, pressure, millis in frame.itertuples(index=False):
            latest = max(latest, int(millis))
            if down:
                if open_:
                    done.append((number, [*self.kept(), *fresh]))
                number, open_, fresh = number + 1, True, []
            if open_:
                fresh.append((int(seq), *(None if pd.isna(v) else float(v) for v in (x, y)), 0.5 if pd.isna(pressure) else float(pressure)))
                # A pointer that goes down and up in one event goes on: what ends a stroke comes after its first point.
                if up and not down:
                    done.append((number, [*self.kept(), *fresh]))
                    open_, fresh = False, []
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = latest + self.rest // 1000 if open_ else None
        if timer is not None:
            self.handle.registerTimer(timer)
        if fresh:
            self.points.appendList(fresh)
        self.stroke.update((number, open_, timer))
        yield self.frame(key, done)

    def kept(self) -> list[tuple]:
        """The points held from earlier micro-batches, which are then held no more."""
        held = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        self.points.clear()
        return held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, open_, _ = self.stroke.get()
        if open_:
            self.stroke.update((number, False, None))
            yield self.frame(key, [(number, self.kept())])

    def frame(self, key, done: list[tuple]) -> pd.DataFrame:
        names = ("seq", "x", "y", "pressure")
        return pd.DataFrame({"user": pd.Series([key[0]] * len(done), dtype="int64"), "stroke_id": pd.Series([n for n, _ in done], dtype="int64"), "points": pd.Series([[dict(zip(names, p)) for p in points] for _, points in done], dtype=object)})

    def close(self) -> None:
        pass


def stroke_stream(events: DataFrame, down: Column, up: Column, path: str, checkpoint: str, rest: int = REST, lateness: int = 0) -> DataFrame:
    """(user, stroke_id, points): the strokes of a stream of pointer events (user, seq, ts, x, y, pressure), each once it has ended:
    by an event ``up`` (released, cancelled, left), by the next ``down``, or by ``rest`` microseconds without an event.

    A user's events come in the order of ``seq`` from micro-batch to micro-batch. The strokes are those of ``stroked`` on the same
    events, whatever the cut into micro-batches, but that one which rests is over. An open stroke's points are its state.
    """
    rows = events.select(F.col("user").cast("long"), F.col("seq").cast("long"), F.col("ts").cast("timestamp"), F.coalesce(down, F.lit(False)).alias("down"), F.coalesce(up, F.lit(False)).alias("up"), *(F.col(c).cast("double") for c in ("x", "y", "pressure")))
    rows = rows.where("user is not null and seq is not null and ts is not null").withWatermark("ts", f"{lateness // 1000} milliseconds").withColumn("millis", F.unix_millis("ts"))
    return drained(rows, Strokes(rest), "user", f"user long, stroke_id long, points {POINTS}", path, checkpoint)
