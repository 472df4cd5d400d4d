"""SVG documents and path data as column expressions.

Path data is folded command by command with the built-in ``aggregate``; no Python runs. A fold that
grows an array copies it at each step, so commands are folded ``RUN`` at a time, each run into an
array of its own: work grows with the length of a path and not with its square. Commands without the numbers they need give nulls; arcs and smooth curves are skipped and leave the
current point; closing a path leaves it too; numbers may not start with a point, so ".5" is 5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of path elements, sizes, scales, commands and numbers, which decide what is read.
PATH_DATA = '<path[^>]*\\bd="([^"]+)"'
VIEW_BOX = r'viewBox="\s*\S+\s+\S+\s+(\S+)\s+(\S+)\s*"'
SCALE = r"scale\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)"
COMMAND = "[MmLlHhVvCcSsQqTtAaZz][^MmLlHhVvCcSsQqTtAaZz]*"
NUMBER = r"(?i)-?\d+\.?\d*(?:e[+-]?\d+)?"

#: Commands of a path folded into one array.
RUN = 64
POINT = "type string, x double, y double, x1 double, y1 double, x2 double, y2 double"


def svg_paths(svg: Column) -> Column:
    """The path data of all path elements, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(svg, F.lit(PATH_DATA), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _number(text: Column) -> Column:
    return F.when(text != "", text.try_cast("double"))


def svg_size(svg: Column) -> Column:
    """(width, height) from the first such attributes, else from the view box, else null."""
    side = lambda name: _number(F.regexp_extract(svg, name + r'="(\d+(?:\.\d+)?)(?:px)?"', 1))
    box = lambda k: _number(F.regexp_extract(svg, VIEW_BOX, k))
    direct = F.when(side("width").isNotNull() & side("height").isNotNull(), F.struct(side("width").alias("width"), side("height").alias("height")))
    return F.coalesce(direct, F.when(box(1).isNotNull() & box(2).isNotNull(), F.struct(box(1).alias("width"), box(2).alias("height"))))


def svg_scale(svg: Column) -> Column:
    """The size of the first scale(a, b); null without both arguments."""
    return F.abs(_number(F.regexp_extract(svg, SCALE, 1)))


def traced_height(svg: Column) -> Column:
    """Height in path units: the document's height over its scale; null if either is missing or 0."""
    return svg_size(svg)["height"] / F.nullif(svg_scale(svg), F.lit(0.0))


def parse_path(d: Column) -> Column:
    """Path data as an array of absolute commands (type, x, y, x1, y1, x2, y2) of types M, L, C, Q and Z."""
    tokens = F.regexp_extract_all(d, F.lit(COMMAND), F.lit(0))
    coded = F.transform(
        tokens,
        lambda t: F.struct(
            F.substring(t, 1, 1).alias("c"),
            F.transform(F.regexp_extract_all(F.substring(t, 2, 1 << 30), F.lit(NUMBER), F.lit(0)), lambda n: n.cast("double")).alias("n"),
        ),
    )

    def steps(t: Column) -> Column:
        kind = F.upper(t["c"])
        arity = F.when(kind.isin("H", "V"), 1).when(kind.isin("M", "L"), 2).when(kind == "Q", 4).otherwise(6)
        count = F.when(kind == "Z", 1).when(kind.isin("S", "T", "A"), 0).otherwise(F.ceil(F.size(t["n"]) / arity)).cast("int")
        nth = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(nth, lambda i: F.struct(t["c"].alias("c"), i.alias("i"), F.slice(t["n"], i * arity + 1, arity).alias("n")))

    def step(s: Column, t: Column) -> Column:
        kind, n = F.upper(t["c"]), lambda k: F.get(t["n"], F.lit(k))
        relative = t["c"] != kind
        bx, by = F.when(relative, s["x"]).otherwise(0.0), F.when(relative, s["y"]).otherwise(0.0)
        last = F.when(kind == "C", 4).when(kind == "Q", 2).otherwise(0)
        x = F.when(kind.isin("V", "Z"), s["x"]).otherwise(bx + F.get(t["n"], last))
        y = F.when(kind.isin("H", "Z"), s["y"]).when(kind == "V", by + n(0)).otherwise(by + F.get(t["n"], last + 1))
        name = F.when((kind == "M") & (t["i"] == 0), "M").when(kind.isin("C", "Q", "Z"), kind).otherwise("L")
        curve, cubic, drawn = kind.isin("C", "Q"), kind == "C", kind != "Z"
        point = F.struct(
            name.alias("type"),
            F.when(drawn, x).alias("x"),
            F.when(drawn, y).alias("y"),
            F.when(curve, bx + n(0)).alias("x1"),
            F.when(curve, by + n(1)).alias("y1"),
            F.when(cubic, bx + n(2)).alias("x2"),
            F.when(cubic, by + n(3)).alias("y2"),
        )
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(point)).alias("out"))

    none = F.array().cast(f"array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>")
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), none.alias("out"))

    def run(s: Column, some: Column) -> Column:
        # The run's fold stands once in the expression; a second mention would evaluate it again.
        inner = F.aggregate(some, F.struct(s["last"]["x"].alias("x"), s["last"]["y"].alias("y"), none.alias("out")), step)
        return F.struct(inner.alias("last"), F.concat(s["runs"], F.array(s["last"]["out"])).alias("runs"))

    runs = F.aggregate(
        runs_of(F.flatten(F.transform(coded, steps))),
        F.struct(start.alias("last"), F.array().cast(f"array<array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>>").alias("runs")),
        run,
        lambda s: F.concat(s["runs"], F.array(s["last"]["out"])),
    )
    return F.flatten(runs)


def runs_of(steps: Column) -> Column:
    """``steps`` cut into arrays of ``RUN``; null for null."""
    return F.transform(F.array(steps), lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(all_) - 1), F.lit(RUN)), lambda i: F.slice(all_, i + 1, RUN)))[0]


def path_box(commands: Column) -> Column:
    """(min_x, min_y, max_x, max_y) over end and control points."""
    def every(axis: str) -> Column:
        return F.flatten(F.transform(commands, lambda p: F.array(p[axis], p[axis + "1"], p[axis + "2"])))

    return F.struct(F.array_min(every("x")).alias("min_x"), F.array_min(every("y")).alias("min_y"), F.array_max(every("x")).alias("max_x"), F.array_max(every("y")).alias("max_y"))


def path_area(commands: Column) -> Column:
    """The area that closed paths of M, L, C and Z commands enclose, counter-clockwise above 0."""
    cross = lambda ax, ay, bx, by: ax * by - ay * bx
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        line = cross(s["x"], s["y"], c["x"], c["y"]) / 2
        a, b, d = (s["x"], s["y"]), (c["x1"], c["y1"]), (c["x"], c["y"])
        e = (c["x2"], c["y2"])
        curve = (6 * cross(*a, *b) + 3 * cross(*a, *e) + cross(*a, *d) + 3 * cross(*b, *e) + 3 * cross(*b, *d) + 6 * cross(*e, *d)) / 20
        back = cross(s["x"], s["y"], s["mx"], s["my"]) / 2
        kind = c["type"]
        grown = F.when(kind == "M", 0.0).when(kind == "Z", back).when(kind == "C", curve).otherwise(line)
        at = lambda now, begin: F.when(kind == "Z", begin).otherwise(now)
        moved = lambda now, begin: F.when(kind == "M", now).otherwise(begin)
        return F.struct(at(c["x"], s["mx"]).alias("x"), at(c["y"], s["my"]).alias("y"), moved(c["x"], s["mx"]).alias("mx"), moved(c["y"], s["my"]).alias("my"), (s["sum"] + grown).alias("sum"))

    return F.aggregate(commands, none, step, lambda s: s["sum"])


def stroke_path(points: Column) -> Column:
    """A smooth closed path through outline points (x, y), two decimals; empty for fewer than four."""
    text = lambda v: F.format_string("%.2f", F.floor(v * 100 + 0.5) / 100)
    pair = lambda x, y: F.concat(text(x), F.lit(","), text(y))
    p = lambda k: F.get(points, F.lit(k))
    middle = lambda a, b: pair((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    rest = F.transform(F.sequence(F.lit(2), F.size(points) - 2), lambda i: F.concat(middle(F.get(points, i), F.get(points, i + 1)), F.lit(" ")))
    path = F.concat(F.lit("M"), pair(p(0)["x"], p(0)["y"]), F.lit(" Q"), pair(p(1)["x"], p(1)["y"]), F.lit(" "), middle(p(1), p(2)), F.lit(" T"), F.array_join(rest, ""), F.lit("Z"))
    return F.when(F.size(points) >= 4, path).otherwise("")
