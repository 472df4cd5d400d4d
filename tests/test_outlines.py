"""Component labels and curved outlines against brute force, and their time on large winding images."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import svgpath
from vellumspark.operators import components, curves, trace


def flood(ink):
    out = np.full(ink.shape, -1)
    for y, x in zip(*np.nonzero(ink)):
        if out[y, x] < 0:
            out[y, x], todo = y * ink.shape[1] + x, [(y, x)]
            while todo:
                b, a = todo.pop()
                for v in range(max(0, b - 1), min(ink.shape[0], b + 2)):
                    for u in range(max(0, a - 1), min(ink.shape[1], a + 2)):
                        if ink[v, u] and out[v, u] < 0:
                            out[v, u] = y * ink.shape[1] + x
                            todo.append((v, u))
    return out


def winding(n):
    ink = np.zeros((n, n), bool)
    ink[::2] = True
    for k in range(1, n, 2):
        ink[k, -1 if k % 4 == 1 else 0] = True
    return ink


def random_images(seed, n):
    r = np.random.default_rng(seed)
    return [r.random((r.integers(1, 15), r.integers(1, 15))) < r.choice([0.0, 0.2, 0.5, 0.8, 1.0]) for _ in range(n)]


def test_roots_equal_a_flood_fill():
    for ink in random_images(1, 300):
        assert (components.roots(ink) == flood(ink)).all()


@pytest.mark.parametrize("turned", [False, True])
def test_roots_of_a_large_winding_image_take_little_time(turned):
    ink = winding(1200).T.copy() if turned else winding(1200)
    began = time.process_time()
    root = components.roots(ink)
    assert time.process_time() - began < 1.0
    assert (root[ink] == 0).all() and (root[~ink] == -1).all()


@pytest.mark.parametrize("tile", [3, 8])
def test_tiles_give_the_same_labels(spark, tile):
    r = np.random.default_rng(tile)
    images = [r.random((r.integers(1, 25), r.integers(1, 25))) < d for d in (0.3, 0.45, 0.6, 1.0)] + [winding(20)]
    rows = [(i, x, y, 255 if ink[y, x] else 0) for i, ink in enumerate(images) for y in range(ink.shape[0]) for x in range(ink.shape[1])]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, ink int")
    whole, tiled = components.label_map(px), components.label_map(px, tile=tile)
    assert whole.exceptAll(tiled).count() == tiled.exceptAll(whole).count() == 0
    assert components.label_map(px.limit(0), tile=tile).count() == 0


def disc(n, radius):
    y, x = np.indices((n, n))
    return (x - n / 2 + 0.3) ** 2 + (y - n / 2) ** 2 < radius**2


SHAPES = {
    "disc": disc(60, 25),
    "ring": disc(90, 40) & ~disc(90, 25),
    "pixel": np.ones((1, 1), bool),
    "line": np.ones((1, 40), bool),
    "slope": np.arange(200)[None, :] < np.arange(60)[:, None] * 3 + 2,
    "stairs": np.tril(np.ones((50, 50), bool)),
    "winding": winding(60),
    **{f"noise{k}": np.random.default_rng(k).random((30, 30)) < d for k, d in enumerate((0.1, 0.3, 0.5, 0.7, 0.9))},
}


def far(points, line):
    """The largest distance of points from a closed chain of lines."""
    a, b = line, np.roll(line, -1, 0)
    t = np.clip(((points[:, None] - a) * (b - a)).sum(2) / np.maximum(((b - a) ** 2).sum(1), 1e-12), 0, 1)
    return np.sqrt((((a + t[..., None] * (b - a)) - points[:, None]) ** 2).sum(2)).min(1).max()


def sampled(parts):
    t = np.linspace(0, 1, 9)[:, None]
    out = []
    for p in parts:
        p = np.array(p)
        out.append((1 - t) * p[0] + t * p[1] if len(p) == 2 else (1 - t) ** 3 * p[0] + 3 * t * (1 - t) ** 2 * p[1] + 3 * t * t * (1 - t) * p[2] + t**3 * p[3])
    return np.concatenate(out)


@pytest.mark.parametrize("name", SHAPES)
def test_curves_stay_within_a_pixel_of_the_outline(name):
    ink = SHAPES[name]
    total = 0.0
    for path in trace.outline(ink, minority=True):
        parts = curves.smooth(path)
        for one, two in zip(parts, parts[1:] + parts[:1]):
            assert np.allclose(one[-1], two[0])
        line = sampled(parts)
        edges = np.concatenate([np.linspace(a, b, 5)[:-1] for a, b in zip(np.array(path, float), np.array(path[1:] + path[:1], float))])
        assert max(far(line, np.array(path, float)), far(edges, line)) < 1
        total += (line[:, 0] * np.roll(line[:, 1], -1) - line[:, 1] * np.roll(line[:, 0], -1)).sum() / 2
    padded = np.pad(ink, 1)
    border = sum((padded & ~np.roll(padded, s, a)).sum() for s in (1, -1) for a in (0, 1))
    assert abs(total - ink.sum()) <= 0.25 * border


def test_curves_are_few_on_round_and_sloping_shapes():
    one = lambda ink: curves.smooth(trace.outline(ink, minority=True)[0])
    assert sum(len(p) == 4 for p in one(disc(700, 300))) < 120
    assert len(one(SHAPES["slope"])) < 15 and len(one(SHAPES["stairs"])) < 15
    assert len(curves.smooth(trace.outline(disc(60, 25))[0], tolerance=0)) > len(one(disc(60, 25)))


def test_joined_curves_keep_their_area():
    parts = curves.smooth(trace.outline(disc(200, 80))[0], tolerance=0)
    a, b = [p for p in parts if len(p) == 4][:2]
    c = curves.joined([a, b], 5.0) if a[3] == b[0] else None
    if c:
        area = sum(curves.curve_area(*p) for p in (a, b)) + (c[3][0] * c[0][1] - c[3][1] * c[0][0]) / 2
        assert abs(curves.curve_area(*c) + (c[3][0] * c[0][1] - c[3][1] * c[0][0]) / 2 - area) < 1e-9


def test_long_outlines_take_linear_time():
    def took(n):
        path = trace.outline(np.tril(np.ones((n, n), bool)))[0]
        began = time.process_time()
        curves.smooth(path)
        return time.process_time() - began

    took(100)
    assert took(1200) < 10 * took(300)
    began = time.process_time()
    assert len(trace.outline(winding(1200))) == 1
    assert time.process_time() - began < 8


def test_minority_joins_scarce_ink():
    ink = np.zeros((9, 9), bool)
    ink[4, 4] = ink[5, 5] = True
    assert len(trace.outline(ink)) == 2 and len(trace.outline(ink, minority=True)) == 1
    assert len(trace.outline(~ink)) == 2 and len(trace.outline(~ink, minority=True)) == 2


def test_traced_curves_drop_specks_and_read_back(spark):
    ink = np.zeros((40, 40), bool)
    ink[5:30, 5:30] = disc(25, 11)
    ink[1, 1] = True
    rows = [(1, x, y, 255 if ink[y, x] else 0) for y in range(40) for x in range(40)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, ink int")
    one, every = (trace.traced(px, curves=True, despeckle=d).first() for d in (2, 0))
    assert len(one.paths) == 1 and len(every.paths) == 2 and " C" in one.paths[0]
    got = spark.createDataFrame([(d,) for d in every.paths], "d string").select(svgpath.path_area(svgpath.parse_path(F.col("d"))).alias("a")).agg(F.sum("a")).first()[0]
    assert abs(got - ink.sum()) < 8
