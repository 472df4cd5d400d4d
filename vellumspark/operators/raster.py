"""Raster operators over exploded pixels (image_id, x, y, value).

All frames are separable: one window along rows, one along columns. Both windows cluster on
image_id, so one shuffle by image serves every operator of a chain. Tasks are as large as their
images, whose size is bounded, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_image(px: DataFrame) -> DataFrame:
    """Rows of an image together: the one shuffle the windows below need."""
    return px.repartition("image_id")


def along_x(radius: int) -> W:
    return W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)


def along_y(radius: int) -> W:
    return W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)


def grayscale(px: DataFrame) -> DataFrame:
    """Luma of (r, g, b), rounded half up; alpha plays no part."""
    return px.select("image_id", "x", "y", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int").alias("g"))


def inverted(px: DataFrame, value: str = "g") -> DataFrame:
    return px.withColumn(value, 255 - F.col(value))


def _box(px: DataFrame, value: str, radius: int) -> DataFrame:
    """Sum ``s`` and count ``n`` over the square frame clipped at the image's edges."""
    rows = px.withColumns({"s": F.sum(value).over(along_x(radius)), "n": F.count("*").over(along_x(radius))})
    return rows.withColumns({"s": F.sum("s").over(along_y(radius)), "n": F.sum("n").over(along_y(radius))})


def rgba(px: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, x, y, r, g, b, a): ink black on opaque white."""
    return px.select("image_id", "x", "y", *((255 - F.col(value)).cast("int").alias(c) for c in "rgb"), F.lit(255).alias("a"))


def blur(px: DataFrame, value: str = "g", radius: int = 2) -> DataFrame:
    """Mean of the clipped square frame, rounded half up."""
    mean = F.col("s").cast("double") / F.col("n")
    return _box(by_image(px), value, radius).withColumn(value, F.floor(mean + 0.5).cast("int")).drop("s", "n")


def adaptive_threshold(px: DataFrame, value: str = "g", block: int = 21, c: float = 10) -> DataFrame:
    """(image_id, x, y, ink): 255 where a pixel is darker than its block's unrounded mean by more than ``c``."""
    ink = F.col(value) < F.col("s").cast("double") / F.col("n") - c
    return _box(by_image(px), value, (block - 1) // 2).select("image_id", "x", "y", F.when(ink, 255).otherwise(0).alias("ink"))


def histogram(px: DataFrame, value: str = "g") -> DataFrame:
    return px.groupBy("image_id", F.col(value).alias("g")).agg(F.count("*").alias("n"))


def otsu(px: DataFrame, value: str = "g") -> DataFrame:
    """(image_id, threshold): the least level of greatest between-class variance; 0 for uniform images."""
    up_to = W.partitionBy("image_id").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image_id")
    tokens = F.col("n") * F.col("g")
    h = histogram(px, value).withColumns(
        {"wb": F.sum("n").over(up_to), "sb": F.sum(tokens).over(up_to), "all": F.sum("n").over(whole), "total": F.sum(tokens).over(whole)}
    )
    wf = F.col("all") - F.col("wb")
    mb, mf = F.col("sb").cast("double") / F.col("wb"), (F.col("total") - F.col("sb")).cast("double") / wf
    v = F.when(wf > 0, F.col("wb").cast("double") * wf * (mb - mf) * (mb - mf))
    best = F.max(F.when(v > 0, F.struct(v.alias("v"), (-F.col("g")).alias("g"))))
    return h.groupBy("image_id").agg(F.coalesce(-best["g"], F.lit(0)).cast("int").alias("threshold"))


def otsu_ink(px: DataFrame, value: str = "g") -> DataFrame:
    """(image_id, x, y, ink): 255 up to the image's threshold."""
    return px.join(otsu(px, value), "image_id").select("image_id", "x", "y", F.when(F.col(value) <= F.col("threshold"), 255).otherwise(0).alias("ink"))


def _radius(size: int) -> int:
    return (size - 1) // 2


def dilate(px: DataFrame, value: str = "ink", width: int = 3, height: int = 3) -> DataFrame:
    """Greatest value of the frame; an even size counts as the odd one below it."""
    rows = by_image(px).withColumn(value, F.max(value).over(along_x(_radius(width))))
    return rows.withColumn(value, F.max(value).over(along_y(_radius(height))))


def erode(px: DataFrame, value: str = "ink", width: int = 3, height: int = 3) -> DataFrame:
    """Least value of the frame; what lies outside the image counts as 0."""

    def least(frame: W, radius: int) -> Column:
        return F.when(F.count("*").over(frame) == 2 * radius + 1, F.min(value).over(frame)).otherwise(0)

    rows = by_image(px).withColumn(value, least(along_x(_radius(width)), _radius(width)))
    return rows.withColumn(value, least(along_y(_radius(height)), _radius(height)))


def close(px: DataFrame, value: str = "ink", width: int = 3, height: int = 3) -> DataFrame:
    return erode(dilate(px, value, width, height), value, width, height)


def ink_bounds(px: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, x, y, w, h): the smallest box of each image's ink."""
    box = px.where(F.col(value) == 255).groupBy("image_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return box.select("image_id", "x", "y", (F.col("x2") - F.col("x") + 1).alias("w"), (F.col("y2") - F.col("y") + 1).alias("h"))


def centred_glyph(px: DataFrame, value: str = "ink", pad: int = 10) -> DataFrame:
    """(image_id, x, y, value, width, height): ink pixels moved to the middle of a square with ``pad`` around their
    box, the rest of which is background; an image without ink stays as it is."""
    ink = F.col(value) == 255
    whole = W.partitionBy("image_id")
    of_ink = lambda most, at: most(F.when(ink, F.col(at))).over(whole)
    box = {f"{name}_{at}": of_ink(most, at) for at in "xy" for name, most in (("low", F.min), ("high", F.max))}
    size = F.greatest(*(F.col(f"high_{at}") - F.col(f"low_{at}") + 1 for at in "xy")) + 2 * pad
    # Catalyst plans both windows of an image on one shuffle.
    rows = px.withColumns(box | {f"most_{at}": F.max(at).over(whole) + 1 for at in "xy"}).withColumn("size", size).where(ink | F.col("size").isNull())
    shift = lambda at: F.coalesce(F.col(at) - F.col(f"low_{at}") + F.floor((F.col("size") - (F.col(f"high_{at}") - F.col(f"low_{at}") + 1)) / 2), at).cast("int").alias(at)
    return rows.select("image_id", shift("x"), shift("y"), value, F.coalesce("size", "most_x").alias("width"), F.coalesce("size", "most_y").alias("height"))
