"""A fixed-window rate limiter anchored at each client's first request.

A window opens with the first request at or after the previous window's end; of its requests the
first ``most`` are allowed, and those denied neither extend nor reopen it. In batch the requests are
dealt by client and sorted inside the partitions (a sort that spills); one pass then carries a few
numbers per client, so a client of any size needs no more memory than a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = "client long, id long, ts timestamp, allowed boolean, remaining int, reset timestamp"
#: Microseconds of the default window and the requests it allows.
WINDOW, MOST = 60_000_000, 15


def decide(ts: np.ndarray, window: int, most: int, reset: int | None, count: int) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """(count of each request in its window, its window's end) for one client's ordered times, and the state after them."""
    counts, resets = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
    at = 0
    while at < len(ts):
        if reset is None or ts[at] >= reset:
            reset, count = int(ts[at]) + window, 0
        end = at + int(np.searchsorted(ts[at:], reset))
        counts[at:end], resets[at:end] = np.arange(count + 1, count + 1 + end - at), reset
        count += end - at
        at = end
    return counts, resets, reset, count


def limited(requests: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """(client, id, ts, allowed, remaining, reset) of requests (client, id, ts), ordered by time and then id."""
    return carried(requests, None, window, most).where("kind = 'decision'").drop("kind", "count")


def carried(requests: DataFrame, before: DataFrame | None, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """Decisions on requests that follow on the states ``before`` (client, reset, count), and the states after them.

    Rows of kind "decision" are those of ``limited``; one row of kind "state" a client has the end of
    its window and how many requests that has seen.
    """
    names = ["kind", "client", "id", "ts", "allowed", "remaining", "reset", "count"]
    micros = lambda x: pa.array(x).cast(pa.timestamp("us", "UTC"))

    def states(held: list[tuple[int, int, int]]) -> pa.RecordBatch:
        n, (client, reset, count) = len(held), (np.array([h[k] for h in held], np.int64) for k in range(3))
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.timestamp("us", "UTC"), pa.bool_(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(["state"] * n, pa.string()), pa.array(client), *none, micros(reset), pa.array(count)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, reset, count = None, None, 0
        for batch in batches:
            clients, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ts = batch.column(2).cast(pa.int64()).to_numpy()
            seen = batch.column(3).fill_null(-1).to_numpy()
            counts, resets, held = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64), []
            edges = np.flatnonzero(np.diff(clients, prepend=clients[:1] - 1)).tolist() + [len(ts)]
            for a, b in zip(edges[:-1], edges[1:]):
                if clients[a] != client:
                    if client is not None:
                        held.append((client, reset, count))
                    client, reset, count = clients[a], None, 0
                if seen[a] >= 0:
                    reset, count, a = int(ts[a]), int(seen[a]), a + 1
                counts[a:b], resets[a:b], reset, count = decide(ts[a:b], window, most, reset, count)
            own = np.flatnonzero(seen < 0)
            left = np.maximum(0, most - counts[own]).astype(np.int32)
            decided = [pa.array(["decision"] * len(own), pa.string()), pa.array(clients[own]), pa.array(ids[own]), micros(ts[own]), pa.array(counts[own] <= most), pa.array(left), micros(resets[own])]
            yield pa.RecordBatch.from_arrays([*decided, pa.nulls(len(own), pa.int64())], names)
            yield states(held)
        if client is not None:
            yield states([(client, reset, count)])

    rows = requests.select(F.col("client").cast("long"), F.col("id").cast("long"), F.col("ts").cast("timestamp"), F.lit(None).cast("long").alias("seen"))
    if before is not None:
        rows = before.select("client", F.lit(0).cast("long").alias("id"), F.col("reset").alias("ts"), F.col("count").alias("seen")).unionByName(rows)
    rows = rows.where("client is not null and ts is not null")
    ordered = rows.repartition("client").sortWithinPartitions("client", F.col("seen").isNull(), "ts", "id")
    return ordered.mapInArrow(run, f"kind string, {DECISIONS}, count long")


def retry_after(reset, now):
    """Whole seconds until the window ends."""
    return F.ceil((F.unix_micros(reset) - F.unix_micros(now)) / 1_000_000)
