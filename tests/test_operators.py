"""Operators against small cases with known results, and against brute force."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import svgpath, web
from vellumspark.operators import components, debugviz, font, limiter, match, raster, recognise, strokes, trace
from vellumspark.plans import drawing, photo
from vellumspark.sources import images


def pixels(spark, image, value="g"):
    h, w = image.shape
    return spark.createDataFrame([(1, x, y, int(image[y, x])) for y in range(h) for x in range(w)], f"image_id long, x int, y int, {value} int")


def image_of(df, value, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def test_luma(spark):
    px = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (1, 1, 0, 0, 0, 0), (1, 2, 0, 255, 0, 0), (1, 3, 0, 0, 255, 0)], "image_id int, x int, y int, r int, g int, b int")
    assert [r.g for r in raster.grayscale(px).orderBy("x").collect()] == [255, 0, 76, 150]


def test_blur_uniform_and_impulse(spark):
    flat = image_of(raster.blur(pixels(spark, np.full((5, 5), 100))), "g", (5, 5))
    assert (flat == 100).all()
    spot = np.zeros((5, 5), int)
    spot[2, 2] = 255
    assert 0 < image_of(raster.blur(pixels(spark, spot)), "g", (5, 5))[2, 2] < 255


def test_adaptive_threshold_marks_a_dark_line(spark):
    sheet = np.full((50, 50), 200)
    sheet[25, 10:40] = 50
    ink = image_of(raster.adaptive_threshold(pixels(spark, sheet)), "ink", (50, 50))
    assert ink[25, 25] == 255 and ink[0, 0] == 0 and set(np.unique(ink)) == {0, 255}


@pytest.mark.parametrize("low,high", [(30, 220), (10, 240)])
def test_otsu_two_levels(spark, low, high):
    sheet = np.full((10, 10), high)
    sheet[:5] = low
    px = pixels(spark, sheet)
    assert low <= raster.otsu(px).first().threshold <= high
    assert (image_of(raster.otsu_ink(px), "ink", (10, 10)) == np.where(sheet == low, 255, 0)).all()


@pytest.mark.parametrize("level", [0, 128, 255])
def test_otsu_uniform_is_zero(spark, level):
    assert raster.otsu(pixels(spark, np.full((4, 4), level))).first().threshold == 0


@pytest.mark.parametrize("size", [2, 3, 5])
def test_morphology_brute(spark, size):
    ink = np.random.default_rng(size).integers(0, 2, (9, 11)) * 255
    px, r = pixels(spark, ink, "ink"), (size - 1) // 2
    grown, shrunk = np.zeros_like(ink), np.zeros_like(ink)
    for y in range(9):
        for x in range(11):
            frame = ink[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            grown[y, x] = frame.max()
            shrunk[y, x] = frame.min() if frame.size == (2 * r + 1) ** 2 else 0
    assert (image_of(raster.dilate(px, width=size, height=size), "ink", ink.shape) == grown).all()
    assert (image_of(raster.erode(px, width=size, height=size), "ink", ink.shape) == shrunk).all()


def test_close_fills_a_hole(spark):
    ink = np.full((5, 5), 255)
    ink[2, 2] = 0
    assert image_of(raster.close(pixels(spark, ink, "ink")), "ink", (5, 5))[2, 2] == 255


def test_components_keep_by_area(spark):
    ink = np.zeros((10, 10), int)
    ink[0, 0:2] = 255
    ink[5, 0:10] = 255
    px = pixels(spark, ink, "ink")
    stats = components.component_stats(components.label_map(px)).orderBy("label").collect()
    assert [(s.label, s.area, s.x, s.y, s.w, s.h) for s in stats] == [(0, 2, 0, 0, 2, 1), (1, 10, 0, 5, 10, 1)]
    left = image_of(components.remove_small(px, 5), "ink", (10, 10))
    assert left[0].max() == 0 and left[5].min() == 255


def test_component_roots_brute():
    ink = np.random.default_rng(3).random((40, 30)) < 0.4
    got = components.roots(ink)
    label = {p: p[0] * 30 + p[1] for p in zip(*np.nonzero(ink))}
    moved = True
    while moved:
        moved = False
        for y, x in label:
            best = min(label.get((y + dy, x + dx), label[y, x]) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
            moved |= best < label[y, x]
            label[y, x] = best
    assert all(got[p] == v for p, v in label.items()) and (got[~ink] == -1).all()


def test_photo_plan_on_a_read_png(spark, tmp_path):
    sheet = np.full((30, 30, 3), 220, np.uint8)
    sheet[10:16, 5:25] = 20
    (tmp_path / "a.png").write_bytes(debugviz.png(sheet))
    read = images.read_images(spark, str(tmp_path)).first()
    assert (read.width, read.height) == (30, 30)
    rgb = np.frombuffer(read.rgb, np.uint8).reshape(30, 30, 3)
    assert (rgb == sheet).all()
    ink = image_of(photo.photo_ink(pixels(spark, rgb[:, :, 0].astype(int))), "ink", (30, 30))
    assert ink[12, 5] == 255 and ink[0, 0] == 0


def test_wide_images_are_scaled(spark, tmp_path):
    (tmp_path / "w.png").write_bytes(debugviz.png(np.zeros((2, 2400, 3), np.uint8)))
    read = images.read_images(spark, str(tmp_path)).first()
    assert (read.width, read.height) == (1200, 1)


RESPONSE = """{"responses":[{"fullTextAnnotation":{"text":"x","pages":[{"width":100,"height":50,"blocks":[{"paragraphs":[{"words":[{"symbols":[
 {"text":"A","confidence":0.4,"boundingBox":{"vertices":[{"x":1},{"x":2},{"x":2,"y":9},{"x":1,"y":9}]}},
 {"text":"a","confidence":0.5,"boundingBox":{"vertices":[{"x":10},{"x":20},{"x":20,"y":9},{"x":10,"y":9}]}},
 {"text":"a","confidence":0.9,"boundingBox":{"vertices":[{"x":30},{"x":40},{"x":40,"y":9},{"x":30,"y":9}]}},
 {"text":"7","boundingBox":{"vertices":[{"x":1},{"x":9,"y":9}]}},
 {"text":"b","boundingBox":{"vertices":[]}}]}]}]}]}]}}]}"""


def test_first_letters(spark):
    rows = recognise.letters(spark.createDataFrame([(1, RESPONSE), (2, "{broken"), (3, None)], "image_id long, response string")).collect()
    # The tiny first box uses up no letter; the next in order wins over the surer one.
    assert [(r.image_id, r.char, r.x, r.y, r.w, r.h, r.confidence) for r in rows] == [(1, "a", 10, 0, 10, 9, 0.5)]


def test_match_fallback_ties_and_sharing(spark):
    comps = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 20, 0, 10, 10), (1, 2, 20, 20, 10, 10)], "image_id long, label long, x int, y int, w int, h int")
    boxes = spark.createDataFrame([(1, "a", 7, 0, 10, 10), (1, "b", 29, 9, 2, 12), (1, "c", 60, 60, 5, 5), (1, "d", 8, 8, 4, 4), (1, "e", 0, 0, 9, 9)], "image_id long, char string, x int, y int, w int, h int")
    got = {(r.char, r.label) for r in match.matched(comps, boxes).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 0), ("e", 0)}


PATHS = {
    "M10 20 L30 40": [("M", 10, 20), ("L", 30, 40)],
    "m10 20 l5 5": [("M", 10, 20), ("L", 15, 25)],
    "M1 2 3 4": [("M", 1, 2), ("L", 3, 4)],
    "M0 0 H5 V6 h-2 v-3": [("M", 0, 0), ("L", 5, 0), ("L", 5, 6), ("L", 3, 6), ("L", 3, 3)],
    "M0 0 Z l1 1": [("M", 0, 0), ("Z", None, None), ("L", 1, 1)],
    "M1 1 S2 2 3 3 l1 0": [("M", 1, 1), ("L", 2, 1)],
    "M.5 1.5.5 2": [("M", 5, 1.5), ("L", 5, 2)],
    "": [],
}


@pytest.mark.parametrize("d", PATHS)
def test_parse_path(spark, d):
    got = spark.createDataFrame([(d,)], "d string").select(svgpath.parse_path(F.col("d")).alias("c")).first().c
    assert [(c.type, c.x, c.y) for c in got] == PATHS[d]


def test_parse_curves(spark):
    got = spark.createDataFrame([("M1 1 c1 2 3 4 5 6 q1 1 2 2 C0 0 1 1 2 2",)], "d string").select(svgpath.parse_path(F.col("d")).alias("c")).first().c
    assert tuple(got[1]) == ("C", 6, 7, 2, 3, 4, 5) and tuple(got[2]) == ("Q", 8, 9, 7, 8, None, None) and tuple(got[3]) == ("C", 2, 2, 0, 0, 1, 1)


def test_svg_attributes(spark):
    rows = ['<svg width="10px" height="20.5"><path id="a" d="M0 0" x=""/><path d=""/><path d=" M1 1 "/></svg>', '<svg viewBox="0 0 7 8"><g transform="scale(-0.1, 0.1)"/></svg>', "<svg/>"]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select(svgpath.svg_paths(F.col("s")).alias("p"), svgpath.svg_size(F.col("s")).alias("z"), svgpath.svg_scale(F.col("s")).alias("k"))
    a, b, c = df.collect()
    assert a.p == ["M0 0", "M1 1"] and tuple(a.z) == (10, 20.5) and a.k is None
    assert b.p == [] and tuple(b.z) == (7, 8) and b.k == 0.1 and c.z is None


def glyphs(spark, chars):
    d = "M0 0 L100 0 L100 100 L0 100 Z"
    df = spark.createDataFrame([(1, c, [d]) for c in chars], "font_id long, char string, paths array<string>")
    return font.glyph_commands(df).drop("paths")


def test_font_of_the_alphabet(spark):
    made = font.fonts(font.glyph_table(glyphs(spark, "abcdefghijklmnopqrstuvwxyz"))).first()
    read = font.read_font(bytes(made.font))
    assert made.n_glyphs == 54 and len(made.chars) == 26
    assert (read["em"], read["ascender"], read["descender"]) == (1000, 800, -200)
    assert read["codes"][32] == 1 and read["codes"][ord("a")] == 2 and read["codes"][ord("A")] == 3
    assert read["advances"][:3] == [600, 250, 1240]
    for tag, table in read["tables"].items():
        at = made.font.index(tag.encode("latin-1").ljust(4)[:4])
        padded = table + bytes(-len(table) % 4)
        assert struct.unpack(">I", made.font[at + 4 : at + 8])[0] == sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


def test_flat_glyphs_are_dropped(spark):
    df = spark.createDataFrame([(1, "a", ["M0 0 L5 0"]), (1, "b", []), (1, "@", ["M0 0 L2 4 L1 3 Z"])], "font_id long, char string, paths array<string>")
    rows = font.glyph_table(font.glyph_commands(df).drop("paths")).collect()
    assert sorted(r.name for r in rows) == [".notdef", "@", "space"]


def test_punctuation_and_uniform_scale(spark):
    got = {r.char: r for r in font.font_coordinates(glyphs(spark, "a.")).collect()}
    assert got["a"].advance == 1240 and got["a"].commands[0].y == -200 and got["."].commands[2].y == -80
    even = {r.char: r for r in font.font_coordinates(glyphs(spark, "a."), F.lit(7560.0)).collect()}
    assert even["a"].commands[0].y == round((0 - 0.08 * 7560) * 1000 / (0.87 * 7560) - 200) and even["."].commands[2].y == -80


def loop(times, window, most):
    out, reset, count = [], None, 0
    for t in times:
        if reset is None or t >= reset:
            reset, count = t + window, 0
        count += 1
        out.append((count <= most, max(0, most - count), reset))
    return out


def test_limiter_brute(spark):
    r = np.random.default_rng(1)
    rows = [(int(c), i, int(t)) for i, (c, t) in enumerate(zip(r.integers(0, 3, 400), r.integers(0, 600, 400)))]
    zero = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(c, i, zero + datetime.timedelta(seconds=t)) for c, i, t in rows], "client long, id long, ts timestamp")
    got = {x.id: (x.allowed, x.remaining, int((x.reset - zero).total_seconds())) for x in limiter.limited(df).collect()}
    for c in range(3):
        own = sorted((t, i) for k, i, t in rows if k == c)
        assert [got[i] for _, i in own] == loop([t for t, _ in own], 60, 15)


def test_limiter_at_the_reset(spark):
    counts, _, _, _ = limiter.decide(np.array([0, 59, 60, 61]), 60, 1, None, 0)
    assert counts.tolist() == [1, 2, 1, 2]


@pytest.mark.parametrize(
    "row,status",
    [
        ((True, False, True, "application/json", "{}", 200), 403),
        ((False, True, True, "application/json", "{}", 200), 429),
        ((False, False, False, "application/json", "{}", 200), 503),
        ((False, False, True, None, "{}", 200), 415),
        ((False, False, True, "application/json", "{", 200), 400),
        ((False, False, True, "application/json", '{"image":""}', 200), 400),
        ((False, False, True, "application/json", '{"image":"data:x"}', 200), 400),
        ((False, False, True, "application/json", '{"image":"AAAA"}', 403), 502),
        ((False, False, True, "application/json", '{"image":"AAAA"}', 429), 429),
        ((False, False, True, "application/json", '{"image":"AAAA"}', 200), 200),
    ],
)
def test_request_chain(spark, row, status):
    df = spark.createDataFrame([row], "o boolean, l boolean, k boolean, c string, b string, u int")
    assert df.select(web.validate_request(*map(F.col, "olkcbu")).alias("a")).first().a.status == status


def test_web_helpers(spark):
    df = spark.createDataFrame([("  Ana  De-Luna! ", " 1.2.3.4 , 5", "x" * 100)], "n string, f string, t string")
    r = df.select(
        web.file_name(F.col("n")).alias("n"),
        web.client_ip(F.col("f"), F.lit(None)).alias("ip"),
        web.base64_text(F.encode("t", "UTF-8")).alias("b"),
        web.date_slug(F.lit("2026-11-06").cast("date")).alias("d"),
        web.font_format(F.lit(b"wOF2abc")).alias("f"),
        web.font_format(F.lit(b"wO")).alias("g"),
    ).first()
    assert (r.n, r.ip, r.d, r.f, r.g) == ("ana-de-luna", "1.2.3.4", "nov6", "woff2", "truetype") and "\n" not in r.b and len(r.b) == 136


def test_strokes(spark):
    events = "move down move up move down move".split()
    df = spark.createDataFrame([("u", i, e, None) for i, e in enumerate(events)], "user string, seq int, e string, pressure double")
    got = strokes.stroked(df, F.col("e") == "down", F.col("e") == "up").orderBy("seq").collect()
    assert [(r.seq, r.stroke_id, r.pressure) for r in got] == [(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.5), (5, 2, 0.5), (6, 2, 0.5)]


def test_outline_area_and_holes():
    ink = np.random.default_rng(5).random((12, 17)) < 0.5
    area = 0
    for path in trace.outline(ink):
        area += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1])) / 2
    assert area == ink.sum()


def test_png_is_valid():
    data = debugviz.png(np.zeros((3, 2, 3), np.uint8))
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    assert zlib.decompress(data[at + 4 : at + 4 + size]) == bytes(3 * (1 + 6))


def test_sessions(spark):
    rows = [('{"fontBase64":"AA","charsFound":["a"]}',), ('{"fontBase64":"","charsFound":["a"]}',), ("{oops",), (None,), ('{"fontBase64":"AA"}',)]
    got = [r.intact for r in images.read_sessions(spark.createDataFrame(rows, "json string")).collect()]
    assert got == [True, False, False, False, False]


def test_packed_pixels_become_rows(spark):
    rgb = bytes(range(18))
    df = spark.createDataFrame([("a", 3, 2, bytearray(rgb)), ("b", 1, 1, bytearray(b"\xff\x00\x80"))], "origin string, width int, height int, rgb binary")
    got = {(r.origin, r.x, r.y): (r.r, r.g, r.b) for r in images.image_pixels(df).collect()}
    assert got == {("a", i % 3, i // 3): tuple(rgb[3 * i : 3 * i + 3]) for i in range(6)} | {("b", 0, 0): (255, 0, 128)}


def test_uploads_are_images_by_their_bytes(spark):
    contents = [debugviz.png(np.zeros((1, 1, 3), np.uint8)), b"\xff\xd8\xff\xe0x", b"GIF89a", b"text", b"", None]
    df = spark.createDataFrame([(i, c and bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    assert sorted((r.id, r.mime) for r in images.uploads(df).collect()) == [(0, "image/png"), (1, "image/jpeg"), (2, "image/gif")]


def test_fonts_without_glyphs_are_named(spark):
    made = spark.createDataFrame([(1, bytearray(b"f"))], "font_id long, font binary")
    asked = spark.createDataFrame([(1,), (2,)], "font_id long")
    rows = {r.font_id: r.status for r in drawing.with_status(made, asked, F.lit(drawing.NO_GLYPHS)).collect()}
    assert rows == {1: "ok", 2: "no valid glyphs"}
    with pytest.raises(Exception, match="font 2: no valid glyphs"):
        drawing.with_status(made, asked, F.lit(drawing.NO_GLYPHS), strict=True).collect()


def test_blank_drawings_have_no_font(spark):
    px = spark.createDataFrame([(i, x, y, 0 if i == 1 and 1 < x < 5 and 1 < y < 6 else 255) for i in (1, 2) for x in range(8) for y in range(8)], "image_id long, x int, y int, g int")
    places = spark.createDataFrame([(1, 7, "A", 1), (2, 8, "b", 1)], "image_id long, font_id long, char string, entry long")
    rows = {r.font_id: r for r in drawing.drawn_fonts(px, places).collect()}
    assert rows[7].status == "ok" and rows[7].chars == "a" and rows[8].status == drawing.NO_GLYPHS and rows[8].font is None
    assert set(font.read_font(bytes(rows[7].font))["codes"]) == {32, ord("a"), ord("A")}


def test_names_and_picks(spark):
    names = ["\tAna\n", " Mary  Ann ", "漢字", "!!!", "", None, " X﻿"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(web.file_name(F.col("n"))).collect()]
    assert got == ["ana", "mary-ann", "you", "you", "you", "you", "x"]
    numbers = [r[0] for r in spark.range(2000).select(web.seeded(F.col("id"), 5, 7)).collect()]
    assert set(numbers) == set(range(7)) and max(numbers.count(k) for k in range(7)) < 400


def test_long_paths_take_time_in_proportion(spark):
    import time

    spent = []
    for n in (2_000, 40_000):
        d = "M0 0" + "l1 2" * n + "Z"
        df = spark.createDataFrame([(d,)], "d string").select(svgpath.parse_path(F.col("d")).alias("c")).select(F.size("c").alias("n"), F.element_at("c", -2)["x"].alias("x"))
        start = time.perf_counter()
        assert tuple(df.first()) == (n + 2, float(n))
        spent.append(time.perf_counter() - start)
    assert spent[1] < 20 + 40 * spent[0]


def test_saved_state_is_restored(spark):
    from vellumspark.sinks import sessions

    log = [(1, "draw", 1, '{"a":"x"}'), (1, "draw", 2, '{"b":"y"}'), (1, "playground", 3, '{"text":"t","fontSize":2,"noteColorId":"n"}'), (2, "session", 1, "{}"), (2, None, 2, None), (3, "draw", 1, "{}"), (3, "playground", 1, "{oops")]
    rows = {(r.session_id, r.slot): r for r in sessions.current(spark.createDataFrame(log, sessions.LOG)).withColumns({"p": sessions.playground(F.col("json")), "d": sessions.draw_progress(F.col("json"))}).collect()}
    assert set(rows) == {(1, "draw"), (1, "playground"), (3, "draw"), (3, "playground")}
    assert rows[1, "draw"].d == {"b": "y"} and rows[3, "draw"].d is None and rows[1, "playground"].p == ("t", 2.0, "n") and rows[3, "playground"].p is None
