"""Outlines of pointer strokes as column expressions: smoothed points, a radius from the pressure, round joins and caps.

A stroke's points follow the pointer with a lag (an exponential fold); around each stands a circle whose radius
follows the pressure. The outline runs along the left of all circles, around the last, back along the
right and around the first. Points are folded ``RUN`` at a time, as paths are, so work grows with a stroke's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.svgpath import runs_of

#: How a brush draws: the share of the circle that pressure moves, and how far points lag behind the pointer.
THINNING, STREAMLINE = 0.15, 0.6
#: The cosine of 45 degrees: joins and caps turn by eighths of a circle.
EIGHTH = 0.7071067811865476

_POINT = "struct<x:double,y:double,dx:double,dy:double,r:double>"


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def smoothed(points: Column, size: float, thinning: float = THINNING, streamline: float = STREAMLINE) -> Column:
    """(x, y, dx, dy, r) of every point (x, y, pressure): its place, the unit direction it was reached in, and its radius.

    The first point has no direction (0, 0), nor have those that repeat it; a later point that repeats its place keeps the last direction.
    """
    share = 1 - 0.85 * streamline
    none = F.array().cast(f"array<{_POINT}>")
    radius = lambda p: F.greatest(F.lit(0.01), size * (0.5 - thinning * (0.5 - p["pressure"])))

    def step(s: Column, p: Column) -> Column:
        first = s["x"].isNull()
        x = F.when(first, p["x"]).otherwise(s["x"] + (p["x"] - s["x"]) * share)
        y = F.when(first, p["y"]).otherwise(s["y"] + (p["y"] - s["y"]) * share)
        mx, my = F.when(first, 0.0).otherwise(x - s["x"]), F.when(first, 0.0).otherwise(y - s["y"])
        length = F.sqrt(mx * mx + my * my)
        dx, dy = (F.when(length > 0, m / length).otherwise(s[d]) for m, d in ((mx, "dx"), (my, "dy")))
        point = _struct(x=x, y=y, dx=dx, dy=dy, r=radius(p))
        return F.struct(x.alias("x"), y.alias("y"), dx.alias("dx"), dy.alias("dy"), F.concat(s["out"], F.array(point)).alias("out"))

    nothing = F.lit(None).cast("double")
    start = F.struct(nothing.alias("x"), nothing.alias("y"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), none.alias("out"))

    def run(s: Column, some: Column) -> Column:
        last = s["last"]
        inner = F.aggregate(some, F.struct(*(last[c].alias(c) for c in ("x", "y", "dx", "dy")), none.alias("out")), step)
        return F.struct(inner.alias("last"), F.concat(s["runs"], F.array(last["out"])).alias("runs"))

    runs = F.aggregate(runs_of(points), F.struct(start.alias("last"), F.array().cast(f"array<array<{_POINT}>>").alias("runs")), run, lambda s: F.concat(s["runs"], F.array(s["last"]["out"])))
    return F.flatten(runs)


def outline(smooth: Column) -> Column:
    """The outline (x, y) around ``smooth``'s points; null for fewer than two.

    Where the direction turns by more than a right angle a half circle is drawn on either side; elsewhere one point a side lies square to the mean direction.
    """
    at = lambda i: F.get(smooth, i)
    last = F.size(smooth) - 1

    def way(i: Column) -> Column:
        """The direction in which point ``i`` is left: that of the next one, its own at the end, to the right if there is none."""
        own = F.when(i < last, at(i + 1)).otherwise(at(i))
        flat = (own["dx"] == 0) & (own["dy"] == 0)
        return _struct(x=F.when(flat, 1.0).otherwise(own["dx"]), y=own["dy"])

    def came(i: Column) -> Column:
        p = at(i)
        flat = (p["dx"] == 0) & (p["dy"] == 0)
        on = way(i)
        return _struct(x=F.when(flat, on["x"]).otherwise(p["dx"]), y=F.when(flat, on["y"]).otherwise(p["dy"]))

    def off(p: Column, x: Column, y: Column) -> Column:
        return _struct(x=p["x"] + p["r"] * x, y=p["y"] + p["r"] * y)

    def sides(i: Column, side: int) -> Column:
        """Points beside point ``i``, in the order of the stroke; left of direction (x, y) lies (-y, x)."""
        # One transform over a single struct keeps the directions from being spelled out at every use.
        held = F.transform(F.array(F.struct(at(i).alias("p"), came(i).alias("a"), way(i).alias("b"))), lambda h: _beside(h["p"], h["a"], h["b"], side))
        return held[0]

    def _beside(p: Column, a: Column, b: Column, side: int) -> Column:
        mx, my = a["x"] + b["x"], a["y"] + b["y"]
        length = F.sqrt(mx * mx + my * my)
        square = F.array(off(p, -side * (my / length), side * (mx / length)))
        nx, ny = -side * a["y"], side * a["x"]
        turned = F.array(off(p, nx, ny), off(p, (nx + a["x"]) * EIGHTH, (ny + a["y"]) * EIGHTH), off(p, a["x"], a["y"]), off(p, -side * b["y"], side * b["x"]))
        return F.when(a["x"] * b["x"] + a["y"] * b["y"] < 0, turned).otherwise(square)

    def cap(p: Column, x: Column, y: Column) -> Column:
        """A half circle around ``p`` from its left to its right as seen along (x, y)."""
        return F.array(off(p, (x - y) * EIGHTH, (y + x) * EIGHTH), off(p, x, y), off(p, (x + y) * EIGHTH, (y - x) * EIGHTH))

    index = F.sequence(F.lit(0), last)
    left = F.flatten(F.transform(index, lambda i: sides(i, 1)))
    right = F.flatten(F.transform(F.reverse(index), lambda i: F.reverse(sides(i, -1))))
    first, end = at(F.lit(0)), at(last)
    begins, ends = way(F.lit(0)), came(last)
    return F.when(last >= 1, F.concat(left, cap(end, ends["x"], ends["y"]), right, cap(first, -begins["x"], -begins["y"])))


def flattened(points: Column, pieces: int = 4) -> Column:
    """The chain of points (x, y) of the smooth closed path through outline points: quadratic curves whose controls are the
    outline's points and whose ends lie midway between them, each as ``pieces`` lines; empty for fewer than four."""
    p = lambda i: F.get(points, i)
    middle = lambda a, b: _struct(x=(a["x"] + b["x"]) / 2, y=(a["y"] + b["y"]) / 2)

    def curve(i: Column) -> Column:
        a = F.when(i == 1, _struct(x=p(F.lit(0))["x"], y=p(F.lit(0))["y"])).otherwise(middle(p(i - 1), p(i)))
        held = F.transform(F.array(F.struct(a.alias("a"), p(i).alias("b"), middle(p(i), p(i + 1)).alias("c"))), lambda h: F.array(*[_on(h["a"], h["b"], h["c"], k / pieces) for k in range(1, pieces + 1)]))
        return held[0]

    def _on(a: Column, b: Column, c: Column, t: float) -> Column:
        u, v, w = (1 - t) * (1 - t), 2 * t * (1 - t), t * t
        return _struct(**{at: u * a[at] + v * b[at] + w * c[at] for at in "xy"})

    curves = F.flatten(F.transform(F.sequence(F.lit(1), F.size(points) - 2), curve))
    first = F.array(_struct(x=p(F.lit(0))["x"], y=p(F.lit(0))["y"]))
    return F.when(F.size(points) >= 4, F.concat(first, curves)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
