"""Strokes filled as pixels, in the order they were drawn, and letters kept as pictures.

Every edge of a stroke's closed outline crosses rows of pixel centres; a crossing changes the winding number of all
pixels to its right. Crossings are summed per stroke, row and column and run up along the row; pixels whose winding
number is not zero are inside. All of it is joins and windows per stroke and row, so a large canvas or a long stroke is dealt by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.operators.debugviz import png


def _spans(chains: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, y, x, next, winding): every row of a chain's canvas cut where the winding number may change; the last columns end at ``width``."""
    ends = F.arrays_zip(F.col("points").alias("a"), F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1)).alias("b"))
    # A canvas's rows are edges without a winding on its left side, so that all its rows are there, and chains are read once.
    blank = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.struct(*(F.lit(0.0).alias(c) for c in ("ax", "ay", "bx", "by")), y.alias("first"), y.alias("last"), F.lit(0).alias("winds")))

    def edge(e):
        low, high = F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])
        first = F.greatest(F.lit(0), F.ceil(low - 0.5)).cast("int")
        last = F.least(F.lit(height), F.ceil(high - 0.5)).cast("int") - 1
        places = [e[p][c].cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"]
        return F.struct(*places, first.alias("first"), last.alias("last"), F.when(e["b"]["y"] > e["a"]["y"], 1).otherwise(-1).alias("winds"))

    def crosses(e):
        return (e["ay"] != e["by"]) & (e["first"] <= e["last"])

    edges = F.filter(F.transform(F.when(F.size("points") > 1, ends), edge), crosses)
    rows = chains.select(*keys, F.inline(F.concat(blank, F.coalesce(edges, F.slice(blank, 1, 0))))).withColumn("y", F.explode(F.sequence("first", "last")))
    crossing = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    column = F.when(F.col("winds") == 0, 0).otherwise(F.least(F.lit(width), F.greatest(F.lit(0), F.ceil(crossing - 0.5))).cast("int"))
    turns = rows.select(*keys, "y", column.alias("x"), "winds").groupBy(*keys, "y", "x").agg(F.sum("winds").alias("winds"))
    along = W.partitionBy(*keys, "y").orderBy("x")
    return turns.select(*keys, "y", "x", F.coalesce(F.lead("x").over(along), F.lit(width)).alias("next"), F.sum("winds").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("winding"))


def filled(chains: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """(keys, x, y): pixels of a ``width`` by ``height`` canvas whose centres are inside closed chains (keys, points) by the
    nonzero rule. Chains that cross themselves or repeat points are allowed; fewer than two points enclose nothing."""
    spans = _spans(chains, list(keys), width, height).where("winding <> 0 and x < next")
    return spans.select(*keys, F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "y")


def covered(chains: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """(keys, y, x, next, times): the rows of canvases as runs of pixels ``x`` to ``next`` - 1 that ``times`` strokes (keys, turn, points) cover.

    A run stands for its pixels up to here, so what is dealt and sorted grows with the strokes' edges and not with the pixels.
    """
    keys = list(keys)
    spans = _spans(chains, [*keys, "turn"], width, height)
    on = F.when(F.col("winding") != 0, 1).otherwise(0)
    ends = F.inline(F.array(F.struct(F.col("x"), on.alias("more")), F.struct(F.col("next").alias("x"), (-on).alias("more"))))
    steps = spans.select(*keys, "y", ends).groupBy(*keys, "y", "x").agg(F.sum("more").alias("more"))
    along = W.partitionBy(*keys, "y").orderBy("x")
    runs = steps.select(*keys, "y", "x", F.lead("x").over(along).alias("next"), F.sum("more").over(along.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("times"))
    return runs.where("next is not null")


def _level(times: Column, level: Column, ink: int, opacity: float) -> Column:
    """The level of a pixel after ``times`` strokes over ``level``."""
    if opacity == 1.0:
        return F.when(times > 0, ink).otherwise(level)
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), level.cast("int"), lambda v, _: F.floor(v + (ink - v) * opacity + 0.5).cast("int"))).otherwise(level)


def painted(chains: DataFrame, keys: Sequence[str], width: int, height: int, ink: int = 26, opacity: float = 1.0, background: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, g): canvases after all their strokes (keys, turn, points) were filled over white, or over a
    ``background`` (keys, x, y, g), in the order of ``turn``; each stroke moves a pixel's level towards ``ink`` by its ``opacity``.

    Every pixel of a canvas has a row. Strokes have one ink, so a pixel's level depends on how many cover it, and no list of them is gathered.
    """
    keys = list(keys)
    runs = covered(chains, keys, width, height)
    if background is None:
        runs = runs.withColumn("g", _level(F.col("times"), F.lit(255), ink, opacity).cast("int"))
        return runs.select(*keys, F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "y", "g")
    cover = runs.where("times > 0").select(*keys, F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "y", "times")
    canvas = chains.select(*keys).unionByName(background.select(*keys)).distinct()
    every = canvas.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    every = every.join(background.select(*keys, "x", "y", "g"), [*keys, "x", "y"], "left").join(cover, [*keys, "x", "y"], "left")
    return every.select(*keys, "x", "y", _level(F.coalesce("times", F.lit(0)), F.coalesce("g", F.lit(255)), ink, opacity).cast("int").alias("g"))


def pictures(chains: DataFrame, keys: Sequence[str], width: int, height: int, ink: int = 26) -> DataFrame:
    """(keys, png): the canvases of ``painted`` over white as pictures; runs of a canvas meet, its pixels only while its picture is written."""
    keys = list(keys)
    kinds = ", ".join(f"{k} {chains.schema[k].dataType.simpleString()}" for k in keys)
    runs = covered(chains, keys, width, height).where("times > 0 or x = 0")
    whole = runs.groupBy(*keys).agg(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("from"), (F.col("y") * width + F.col("next")).alias("to"), (F.col("times") > 0).alias("on"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, made = batch.column(len(keys)), []
            for i in range(batch.num_rows):
                begin, end, on = (c.to_numpy(zero_copy_only=False) for c in own[i].values.flatten())
                turns = np.zeros(height * width + 1, np.int32)
                np.add.at(turns, begin[on], 1)
                np.add.at(turns, end[on], -1)
                gray = np.where(np.cumsum(turns[:-1]) > 0, ink, 255).astype(np.uint8)
                made.append(png(np.repeat(gray, 3).reshape(height, width, 3)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(made, pa.binary())], [*keys, "png"])

    return whole.mapInArrow(run, f"{kinds}, png binary")


def kept(pictures: DataFrame) -> DataFrame:
    """(session_id, letter, png): the last picture saved of each letter, of pictures (session_id, letter, seq, png)."""
    return pictures.groupBy("session_id", "letter").agg(F.max_by("png", "seq").alias("png"))
