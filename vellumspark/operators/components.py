"""Eight-connected components of ink.

An image is labelled one per group in numpy: its rows become runs of ink, runs that touch in neighbouring rows are
linked, and links are united by their least run, with pointers doubled until every run points at its root. The work
grows with the runs, whatever way a component winds. An image larger than a task is cut into tiles: tiles are
labelled apart, and only the components on either side of a seam are united per image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LABELLED = "image_id long, x int, y int, label int"


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` things the least one that it reaches by the links from ``a`` to ``b``.

    A round hooks every root to the least root linked to it and then doubles all pointers; links
    inside one tree go, so few rounds remain however long a chain of links is.
    """
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            doubled = parent[parent]
            if (doubled == parent).all():
                break
            parent = doubled
    return parent


def runs_of_ink(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of ink in reading order, as places in an image that is one column wider."""
    h, w = ink.shape
    wide = np.zeros((h, w + 1), bool)
    wide[:, :w] = ink
    edges = np.flatnonzero(np.diff(wide.ravel(), prepend=False))
    return edges[::2], edges[1::2]


def touching(starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch by a side or a corner; ``width`` is that of the wider image."""
    low = np.searchsorted(ends, starts - width, "left")
    high = np.searchsorted(starts, ends - width, "right")
    # A run that ends in the last column and one that begins the next row do not touch.
    row = starts // width
    n = np.maximum(0, high - low)
    below = np.repeat(np.arange(len(starts)), n)
    above = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    near = row[above] == row[below] - 1
    return above[near], below[near]


def roots(ink: np.ndarray) -> np.ndarray:
    """The least place of each ink pixel's component, -1 elsewhere."""
    h, w = ink.shape
    starts, ends = runs_of_ink(ink)
    root = united(len(starts), *touching(starts, ends, w + 1))
    out = np.full(h * (w + 1), -1, np.int64)
    least = starts[root]
    least = least - least // (w + 1)
    out[np.flatnonzero(np.pad(ink, ((0, 0), (0, 1))).ravel())] = np.repeat(least, ends - starts)
    return out.reshape(h, w + 1)[:, :w]


def label_image(group: pa.Table) -> pa.Table:
    x, y = group["x"].to_numpy(), group["y"].to_numpy()
    ink = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
    ink[y, x] = True
    _, label = np.unique(roots(ink)[y, x], return_inverse=True)
    return pa.table({"image_id": group["image_id"], "x": group["x"], "y": group["y"], "label": pa.array(label.astype(np.int32))})


def label_map(px: DataFrame, value: str = "ink", tile: int | None = None) -> DataFrame:
    """(image_id, x, y, label) of ink pixels; labels count components in raster order of their first pixels.

    ``tile``: the side of the tiles into which images are cut, for those that are too large for a task.
    """
    ink = px.where(F.col(value) == 255).select(F.col("image_id").cast("long"), F.col("x").cast("int"), F.col("y").cast("int"))
    if tile is None:
        return ink.groupBy("image_id").applyInArrow(label_image, LABELLED)
    return _tiled(ink, tile)


def _tiled(ink: DataFrame, tile: int) -> DataFrame:
    """Labels by tiles: an image's components meet as links across seams, never as pixels."""
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "xy"]

    def label(group: pa.Table) -> pa.Table:
        x, y = group["x"].to_numpy(), group["y"].to_numpy()
        low_x, low_y = x.min(), y.min()
        part = np.zeros((y.max() - low_y + 1, x.max() - low_x + 1), bool)
        part[y - low_y, x - low_x] = True
        first = roots(part)[y - low_y, x - low_x]
        width = part.shape[1]
        # A component is known by its first pixel in reading order.
        place = (first // width + low_y).astype(np.int64) << 32 | (first % width + low_x)
        return pa.table({"image_id": group["image_id"], "x": group["x"], "y": group["y"], "part": pa.array(place)})

    parts = ink.select("image_id", "x", "y", *at).groupBy("image_id", "tx", "ty").applyInArrow(label, "image_id long, x int, y int, part long")
    border = parts.where(((F.col("x") + 1) % tile < 2) | ((F.col("y") + 1) % tile < 2))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))]))
    moved = border.select("image_id", "x", "y", F.col("part").alias("a"), steps.alias("d")).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "a")
    links = moved.join(border.withColumnRenamed("part", "b"), ["image_id", "x", "y"]).where("a <> b").select("image_id", "a", "b").distinct()

    def unite(group: pa.Table) -> pa.Table:
        names, ends = np.unique(np.concatenate([group["a"].to_numpy(), group["b"].to_numpy()]), return_inverse=True)
        root = names[united(len(names), ends[: group.num_rows], ends[group.num_rows :])]
        return pa.table({"image_id": pa.array(np.full(len(names), group["image_id"][0].as_py())), "part": pa.array(names), "root": pa.array(root)})

    whole = links.groupBy("image_id").applyInArrow(unite, "image_id long, part long, root long")
    rooted = parts.join(whole, ["image_id", "part"], "left").select("image_id", "x", "y", F.coalesce("root", "part").alias("root"))
    order = F.row_number().over(W.partitionBy("image_id").orderBy("root")) - 1
    numbers = rooted.select("image_id", "root").distinct().withColumn("label", order)
    return rooted.join(numbers, ["image_id", "root"]).select("image_id", "x", "y", "label")


def component_stats(labels: DataFrame, least_area: int = 1) -> DataFrame:
    """(image_id, label, area, x, y, w, h) of components of at least ``least_area`` pixels; labels keep their numbers."""
    found = labels.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return found.where(F.col("area") >= least_area).select("image_id", "label", "area", "x", "y", (F.col("x2") - F.col("x") + 1).alias("w"), (F.col("y2") - F.col("y") + 1).alias("h"))


def label_counts(labels: DataFrame, least_area: int = 1) -> DataFrame:
    """(image_id, n_components, n_pixels): components of at least ``least_area`` pixels and the ink in them."""
    return component_stats(labels, least_area).groupBy("image_id").agg(F.count("*").alias("n_components"), F.sum("area").alias("n_pixels"))


def valid_label_map(labels: DataFrame, least_area: int = 10) -> DataFrame:
    """The label map with -1 for components below ``least_area``."""
    area = F.count("*").over(W.partitionBy("image_id", "label"))
    return labels.withColumn("label", F.when(area >= least_area, F.col("label")).otherwise(-1))


def remove_small(px: DataFrame, least_area: int, value: str = "ink") -> DataFrame:
    """``px`` (image_id, x, y, value) with components below ``least_area`` turned to background, in one pass over each image."""

    def clean(group: pa.Table) -> pa.Table:
        x, y, level = (group[c].to_numpy() for c in ("x", "y", value))
        ink = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        ink[y, x] = level == 255
        root = roots(ink)[y, x]
        area = np.bincount(root[root >= 0], minlength=ink.size)
        kept = (root >= 0) & (area[root] >= least_area)
        return pa.table({"image_id": group["image_id"], "x": group["x"], "y": group["y"], value: pa.array(np.where(kept, 255, 0).astype(np.int32))})

    rows = px.select(F.col("image_id").cast("long"), F.col("x").cast("int"), F.col("y").cast("int"), value)
    return rows.groupBy("image_id").applyInArrow(clean, f"image_id long, x int, y int, {value} int")


def neighbours(px: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, x, y, degree): ink pixels and how many of the eight around them are ink; each shift is an equi-join."""
    ink = px.where(F.col(value) == 255).select("image_id", "x", "y")
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    shifted = ink.select("image_id", "x", "y", F.explode(around).alias("d")).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    degree = shifted.groupBy("image_id", "x", "y").agg(F.count("*").alias("k"))
    return ink.join(degree, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("k", F.lit(0)).alias("degree"))
