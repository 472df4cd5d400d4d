"""Canvases and their pictures from runs of pixels: as their pixels tell them, with strokes read once."""

import random

import numpy as np

from vellumspark.operators import debugviz, paint


def chains(spark, n=30):
    dice = random.Random(2)
    rows = [(k % 4, k, [(dice.uniform(-4, 20), dice.uniform(-4, 14)) for _ in range(dice.choice([0, 1, 2, 3, 9]))]) for k in range(n)]
    return spark.createDataFrame([*rows, (9, 1, [])], "canvas int, turn int, points array<struct<x:double,y:double>>")


def inside(points, x, y):
    """The nonzero rule at a pixel's centre."""
    wind, cy = 0, y + 0.5
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if min(ay, by) <= cy < max(ay, by) and np.ceil(ax + (cy - ay) * (bx - ax) / (by - ay) - 0.5) <= x:
            wind += 1 if by > ay else -1
    return wind != 0


def test_canvases_read_their_strokes_once(spark):
    df = chains(spark)
    px = paint.painted(df, ["canvas"], 16, 10, opacity=0.5)
    assert px._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert not any("Join" in line for line in px._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = {(p.canvas, p.x, p.y): p.g for p in px.collect()}
    strokes = {}
    for r in df.collect():
        strokes.setdefault(r.canvas, []).append([(p.x, p.y) for p in r.points])
    assert len(got) == len(strokes) * 160
    for (canvas, x, y), g in got.items():
        level = 255
        for _ in range(sum(inside(s, x, y) for s in strokes[canvas])):
            level = int(np.floor(level + (26 - level) * 0.5 + 0.5))
        assert g == level


def test_pictures_of_canvases_are_those_of_their_pixels(spark):
    df = chains(spark)
    made = {r.canvas: bytes(r.png) for r in paint.pictures(df, ["canvas"], 16, 10).collect()}
    plain = {r.canvas: bytes(r.png) for r in debugviz.gray_png(paint.painted(df, ["canvas"], 16, 10), ["canvas"]).collect()}
    assert made == plain
    plan = paint.pictures(df, ["canvas"], 16, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
