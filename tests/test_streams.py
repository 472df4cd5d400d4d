"""Streams with state against their batch forms, in several cuts into micro-batches."""

import numpy as np
from pyspark.sql import functions as F

from vellumspark.operators import limiter, strokes
from vellumspark.streaming import stateful


def test_stream_limiter_equals_the_batch_and_drops_states(spark, tmp_path):
    r = np.random.default_rng(9)
    source, rows = str(tmp_path / "in"), []
    for n in range(4):
        # A hot client, others, and one that is seen in the first batch alone.
        clients = [1] * 60 + r.integers(2, 6, 40).tolist() + ([99] if n == 0 else [])
        rows.append([(int(c), n * 1000 + i, int(n * 30 * 60_000_000 + r.integers(0, 30 * 60_000_000))) for i, c in enumerate(clients)])
        part = spark.createDataFrame(rows[-1], "client long, id long, t long").select("client", "id", F.timestamp_micros("t").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("client long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    progress = str(tmp_path / "progress")
    hour = 3_600_000_000
    got = stateful.limited_stream(stream, str(tmp_path / "out"), progress, window=60_000_000, most=2, lateness=hour // 2)
    everything = spark.createDataFrame([x for part in rows for x in part], "client long, id long, t long").select("client", "id", F.timestamp_micros("t").alias("ts"))
    want = limiter.limited(everything, 60_000_000, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = spark.read.format("statestore").option("stateVarName", "window").load(progress)
    clients = {x[0] for x in held.select("key.client").collect()}
    assert 1 in clients and 99 not in clients


def test_stream_strokes_equal_the_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    kinds = ["down", "move", "move", "move", "up", "cancel"]
    rows = [(int(u), s, kinds[r.integers(0, 6)], float(r.integers(0, 99)), float(s), None if s % 5 == 0 else 0.25, 1000 * s) for s in range(240) for u in [r.integers(1, 4)]]
    # A last event of another user, far on in time, lets every open stroke rest.
    rows += [(9, 1000, "move", 0.0, 0.0, 0.5, 10_000_000), (9, 1001, "move", 0.0, 0.0, 0.5, 20_000_000)]
    names = "user long, seq long, kind string, x double, y double, pressure double, t long"
    down, up = F.col("kind") == "down", F.col("kind").isin("up", "cancel")
    df = spark.createDataFrame(rows, names)
    want = strokes.stroked(df, down, up).groupBy("user", "stroke_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "pressure"))).alias("points"))
    want = sorted((x.user, x.stroke_id, [tuple(p) for p in x.points]) for x in want.collect())
    for cut, cuts in enumerate(([60, 61, 150], [])):
        source = str(tmp_path / f"in{cut}")
        for a, b in zip([0, *cuts, 240, 241], [*cuts, 240, 241, 242]):
            spark.createDataFrame(rows[a:b], names).coalesce(1).select("*", F.timestamp_millis("t").alias("ts")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(f"{names}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        got = stateful.stroke_stream(stream, down, up, str(tmp_path / f"out{cut}"), str(tmp_path / f"progress{cut}"), rest=3_600_000_000)
        assert sorted((x.user, x.stroke_id, [tuple(p) for p in x.points]) for x in got.collect()) == want
