"""Pointer events grouped into strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.functions.outline import outline, smoothed


def stroked(events: DataFrame, down: Column, up: Column) -> DataFrame:
    """``events`` (user, seq, ...) with ``stroke_id``: a stroke runs from a pointer-down to the pointer-up at its
    end; events between strokes are dropped. A missing ``pressure`` is one half."""
    order = W.partitionBy("user").orderBy("seq")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    marked = events.withColumn("stroke_id", F.sum(F.when(down, 1).otherwise(0)).over(so_far))
    # Inside a stroke, nothing before this event has ended it.
    inner = W.partitionBy("user", "stroke_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.when(up, 1).otherwise(0)).over(inner), F.lit(0))
    kept = marked.withColumn("over", over).where("stroke_id > 0 and over = 0").drop("over")
    return kept.withColumn("pressure", F.coalesce("pressure", F.lit(0.5)))


def outlined(strokes: DataFrame, size: float) -> DataFrame:
    """``strokes`` with the ``outline`` of a brush of ``size`` around their ``points`` (x, y, pressure), null for single points.

    Generators keep later filters from copying both expressions into themselves, once for every use of a point.
    """
    others = [c for c in strokes.columns if c not in ("points", "outline")]
    once = lambda x, name: F.inline(F.array(F.struct(x.alias(name))))
    smooth = strokes.select(*others, "points", once(smoothed(F.col("points"), size), "_smooth"))
    return smooth.select(*others, "points", once(outline(F.col("_smooth")), "outline"))


def replay(strokes: DataFrame) -> DataFrame:
    """(user, turn, stroke_id, path, fill): what a canvas draws again after it is cleared: completed strokes
    (user, stroke_id, path, fill), those with a path, in the order they were drawn."""
    order = W.partitionBy("user").orderBy("stroke_id")
    return strokes.where("path <> ''").withColumn("turn", F.row_number().over(order)).select("user", "turn", "stroke_id", "path", "fill")
