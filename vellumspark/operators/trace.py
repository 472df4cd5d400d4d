"""Outlines of binary rasters.

The tracer follows pixel edges: every boundary between ink and background becomes part of
a closed path with the ink on its left, in a coordinate system with y upwards. The area these paths
enclose equals the ink's area. On demand the paths are smoothed to lines and curves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.curves import path_data, smooth


def boundary_edges(px: DataFrame, value: str = "ink") -> DataFrame:
    """(image_id, x, y, side): the edges of ink pixels that face background or the image's outside."""
    ink = px.where(F.col(value) == 255).select("image_id", "x", "y")
    sides = {"left": (-1, 0), "right": (1, 0), "up": (0, -1), "down": (0, 1)}
    around = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, (dx, dy) in sides.items()])
    faces = ink.select("image_id", "x", "y", F.explode(around).alias("f"))
    faces = faces.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.col("f.dx")).alias("x"), (F.col("y") + F.col("f.dy")).alias("y"), "f.side")
    return faces.join(ink, ["image_id", "x", "y"], "left_anti").select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), "side")


def scarce(ink: np.ndarray, radius: int = 3) -> np.ndarray:
    """For each pixel corner (rows from the bottom) whether ink fills less than half of the square around it."""
    sums = np.pad(np.cumsum(np.cumsum(np.pad(ink[::-1], radius).astype(np.int32), 0), 1), ((1, 0), (1, 0)))
    side = 2 * radius
    inside = sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]
    return 2 * inside < side * side


def outline(ink: np.ndarray, minority: bool = False) -> list[list[tuple[int, int]]]:
    """Closed corner paths of a raster (rows from the top), y upwards, corners only.

    Where two pixels of ink touch by a corner they are kept apart; with ``minority`` they are joined where
    ink is the scarcer of the two around that corner. Every edge of ink knows the edge that follows it, so
    the paths are the cycles of that permutation.
    """
    h, w = ink.shape
    padded = np.zeros((h + 2, w + 2), bool)
    padded[1:-1, 1:-1] = ink[::-1]
    # Counter-clockwise around ink: bottom edges run right (0), right edges up (1), top edges left (2), left edges down (3).
    inner = padded[1:-1, 1:-1]
    faces = (inner & ~padded[:-2, 1:-1], inner & ~padded[1:-1, 2:], inner & ~padded[2:, 1:-1], inner & ~padded[1:-1, :-2])
    begins, ends = ((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 0), (1, 1), (0, 1), (0, 0))
    at, to, way = [], [], []
    for d, face in enumerate(faces):
        y, x = np.nonzero(face)
        at.append((x + begins[d][0]) * (h + 1) + y + begins[d][1])
        to.append((x + ends[d][0]) * (h + 1) + y + ends[d][1])
        way.append(np.full(len(x), d))
    at, to, way = (np.concatenate(part) for part in (at, to, way))
    order = np.lexsort((way, at))
    at, to, way = at[order], to[order], way[order]
    leaving = np.full(((w + 1) * (h + 1), 4), -1)
    leaving[at, way] = np.arange(len(at))
    left, ahead, right = (leaving[to, (way + turn) % 4] for turn in (1, 0, 3))
    join = (left >= 0) & (right >= 0) & (scarce(ink)[to % (h + 1), to // (h + 1)] if minority else False)
    follows = np.where(join, right, np.where(left >= 0, left, np.where(ahead >= 0, ahead, right)))
    corner = (way[follows] != way).tolist()
    places, after, seen, paths = to.tolist(), follows.tolist(), bytearray(len(at)), []
    for first in range(len(at)):
        if seen[first]:
            continue
        path, edge = [], first
        while not seen[edge]:
            seen[edge] = 1
            if corner[edge]:
                path.append(divmod(places[edge], h + 1))
            edge = after[edge]
        # The smallest corner leads, as it is where the first edge begins.
        paths.append(path[-1:] + path[:-1])
    return paths


def area(path: list[tuple[int, int]]) -> float:
    """What a closed path encloses; below 0 for the outline of a hole."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1])) / 2


def traced(px: DataFrame, value: str = "ink", curves: bool = False, despeckle: int = 2) -> DataFrame:
    """(image_id, width, height, paths): one path of M and L commands and Z per closed outline; images without ink are left out.

    ``curves``: outlines are smoothed to lines and cubic curves, those that enclose at most ``despeckle`` pixels dropped, and
    pixels that touch by a corner joined where ink is scarce.
    """
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    ink = px.where(F.col(value) == 255).join(sizes, "image_id").select(F.col("image_id").cast("long"), F.col("x").cast("int"), F.col("y").cast("int"), "width", "height")

    def trace(group: pa.Table) -> pa.Table:
        w, h = group["width"][0].as_py(), group["height"][0].as_py()
        raster = np.zeros((h, w), bool)
        raster[group["y"].to_numpy(), group["x"].to_numpy()] = True
        if curves:
            paths = [path_data(smooth(path)) for path in outline(raster, minority=True) if abs(area(path)) > despeckle]
        else:
            paths = ["M" + " L".join(f"{x} {y}" for x, y in path) + " Z" for path in outline(raster)]
        return pa.table({"image_id": group["image_id"][:1], "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "paths": pa.array([paths], pa.list_(pa.string()))})

    return ink.groupBy("image_id").applyInArrow(trace, "image_id long, width int, height int, paths array<string>")


def svg(paths: str = "paths", width: str = "width", height: str = "height"):
    """An SVG document of traced paths, in units of a tenth of a pixel as tracers write them."""
    body = F.array_join(F.transform(F.col(paths), lambda d: F.concat(F.lit('<path d="'), d, F.lit('"/>'))), "")
    return F.format_string('<svg width="%d" height="%d"><g transform="translate(0,%d) scale(1,-1)">%s</g></svg>', F.col(width), F.col(height), F.col(height), body)
