"""Components matched to recognised boxes, and the crops that follow.

The match is an equi-join on the image with the overlap as its residual condition; what a pair
needs is bounded by the components and letters of one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def overlap(a: str, b: str) -> Column:
    """Common area of two boxes; boxes that only touch have none."""
    side = lambda at, size: F.greatest(F.lit(0), F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}")) - F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}")))
    return side("x", "w") * side("y", "h")


def overlaps(components: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, char, label, overlap, inside): pairs with a common area and the share of the component inside the box."""
    a, b = components.alias("a"), boxes.alias("b")
    both = a.join(b, F.col("a.image_id") == F.col("b.image_id")).withColumn("overlap", overlap("a", "b")).where("overlap > 0")
    inside = F.col("overlap").cast("double") / (F.col("a.w") * F.col("a.h"))
    return both.select("a.image_id", "b.char", "a.label", "overlap", inside.alias("inside"))


def matched(components: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """(image_id, char, label): components at least ``least`` inside a box; where a box has none, the one of
    largest overlap, ties to the smaller label. Boxes that overlap nothing do not appear."""
    group = W.partitionBy("image_id", "char")
    ok = F.col("inside") >= least
    rows = overlaps(components, boxes).withColumns({"any": F.max(ok).over(group), "place": F.row_number().over(group.orderBy(F.desc("overlap"), "label"))})
    return rows.where(ok | (~F.col("any") & (F.col("place") == 1))).select("image_id", "char", "label")


def crops(labels: DataFrame, kept: DataFrame, sizes: DataFrame, pad: int = 4) -> DataFrame:
    """(image_id, char, width, height, x, y): ink of the kept components in coordinates of their padded crop.

    ``sizes`` (image_id, width, height) clips the padding at the image's edges.
    """
    px = labels.join(kept, ["image_id", "label"])
    box = px.groupBy("image_id", "char").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")).join(sizes.withColumnsRenamed({"width": "iw", "height": "ih"}), "image_id")
    box = box.select(
        "image_id",
        "char",
        F.greatest(F.lit(0), F.col("x1") - pad).alias("x1"),
        F.greatest(F.lit(0), F.col("y1") - pad).alias("y1"),
        F.least("iw", F.col("x2") + 1 + pad).alias("x2"),
        F.least("ih", F.col("y2") + 1 + pad).alias("y2"),
    )
    return px.join(box, ["image_id", "char"]).select(
        "image_id", "char", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), (F.col("x") - F.col("x1")).alias("x"), (F.col("y") - F.col("y1")).alias("y")
    )
