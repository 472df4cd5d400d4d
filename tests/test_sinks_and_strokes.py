"""Files under a commit protocol, the session store, the recogniser source, navigation, resampling, stroke outlines and fills."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import outline as o
from vellumspark.functions.letters import LETTERS
from vellumspark.operators import debugviz, navigation, paint, recognise, strokes
from vellumspark.sinks import files, sessions
from vellumspark.sources import images, recogniser


def test_files_are_written_once_each(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", bytearray(b"1")), ("b.bin", bytearray(b"")), ("b.bin", None), (None, bytearray(b"2")), ("a/x.bin", bytearray(b"1"))], "n string, d binary")
    for _ in range(2):
        files.write_files(df, f"file://{tmp_path}/o", F.col("n"), F.col("d"))
        assert {r["name"]: bytes(r.content) for r in files.read_files(spark, f"file://{tmp_path}/o").collect()} == {"a/x.bin": b"1"}
        assert sorted(p.name for p in (tmp_path / "o").rglob("*")) == ["a", "b.bin", "x.bin"]


@pytest.mark.parametrize("name", ["../x", "/x", "a/../../x", "a//b", "", ".", "_staging-1/x"])
def test_names_stay_inside_the_folder(spark, tmp_path, name):
    df = spark.createDataFrame([("good", bytearray(b"1")), (name, bytearray(b"2"))], "n string, d binary")
    with pytest.raises(Exception, match="not a name"):
        files.write_files(df, f"file://{tmp_path}/o/i", F.col("n"), F.col("d"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_attempts_that_fail_or_are_overtaken_leave_nothing(tmp_path):
    """Two attempts of a task and one that breaks off: only those whose messages are committed have files."""
    source = files.file_source()({"path": f"file://{tmp_path}/o"})
    writer = source.writer(None, False)

    def broken():
        yield ("a.bin", b"half")
        raise RuntimeError("lost")

    first, twin = writer.write(iter([("a.bin", b"1"), ("d/b.bin", b"2")])), writer.write(iter([("a.bin", b"1"), ("d/b.bin", b"2")]))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not (tmp_path / "o" / "a.bin").exists()
    writer.commit([first, None])
    assert {str(p.relative_to(tmp_path / "o")): p.read_bytes() for p in (tmp_path / "o").rglob("*") if p.is_file()} == {"a.bin": b"1", "d/b.bin": b"2"}
    assert not list((tmp_path / "o").glob("_staging*")) and twin.n == 2
    again = files.file_source()({"path": f"file://{tmp_path}/o"}).writer(None, False)
    again.abort([again.write(iter([("c.bin", b"3")]))])
    assert not (tmp_path / "o" / "c.bin").exists() and not list((tmp_path / "o").glob("_staging*"))


def random_log(seed, n):
    r = random.Random(seed)
    return [(r.randrange(12), r.choice([*sessions.SLOTS, None]) if r.random() < 0.3 else r.choice(sessions.SLOTS), seq, r.choice(["{}", '{"a":1}', "{oops", None])) for seq in r.sample(range(1000), n)]


def test_logs_merge_into_their_buckets(spark, tmp_path):
    path, seen = f"file://{tmp_path}/store", []
    for seed in range(3):
        log = [(s, slot, seq * 3 + seed, j if slot else None) for s, slot, seq, j in random_log(seed, 25)]
        seen += log
        sessions.save(spark.createDataFrame(log, sessions.LOG), path, buckets=4)
        want = sessions.current(spark.createDataFrame(seen, sessions.LOG))
        assert sorted(map(tuple, sessions.load(spark, path).collect())) == sorted(map(tuple, want.collect()))
    sessions.drop_corrupt(spark, path, buckets=4)
    assert sorted(map(tuple, sessions.load(spark, path).collect())) == sorted(tuple(r) for r in want.collect() if r.json != "{oops")


def test_untouched_buckets_stay_as_they_are(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    sessions.save(spark.createDataFrame([(s, "draw", 1, "{}") for s in range(40)], sessions.LOG), path, buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    sessions.save(spark.createDataFrame([(3, "draw", 2, '{"b":"x"}')], sessions.LOG), path, buckets=8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert len(before.keys() - after.keys()) == 1 == len(after.keys() - before.keys()) and len(before) > 2
    assert {r.json for r in sessions.load(spark, path).where("session_id = 3").collect()} == {'{"b":"x"}'}
    sessions.save(spark.createDataFrame([], sessions.LOG), path, buckets=8)
    assert sessions.load(spark, path).count() == 40


PAGE = {"width": 100, "height": 50, "blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "a", "confidence": 0.9, "boundingBox": {"vertices": [{"x": 1, "y": 2}, {"x": 9, "y": 2}, {"x": 9, "y": 12}, {"x": 1, "y": 12}]}}]}]}]}]}


def test_recogniser_calls_its_client_for_every_file(spark, tmp_path):
    good = json.dumps({"responses": [{"fullTextAnnotation": {"text": "a", "pages": [PAGE]}}]})
    answers = {"good": (200, good), "none": (200, '{"responses":[{}]}'), "bare": (200, '{"responses":[{"fullTextAnnotation":{"text":"","pages":[]}}]}'), "broken": (200, "{oops"), "denied": (403, "no"), "busy": (503, ""), "gone": (None, "")}
    for name in answers:
        (tmp_path / f"{name}.png").write_bytes(name.encode())

    def client(request):
        import base64

        asked = json.loads(request)["requests"][0]
        assert asked["features"] == [{"type": "DOCUMENT_TEXT_DETECTION", "maxResults": 1}] and asked["imageContext"] == {"languageHints": ["en"]}
        status, text = answers[base64.b64decode(asked["image"]["content"]).decode()]
        if status is None:
            raise ConnectionError
        return status, text

    df = recogniser.recognised(spark, f"file://{tmp_path}", client, tries=2, files=3)
    rows = {r.path.rpartition("/")[2][:-4]: r for r in df.collect()}
    assert {k: (r.status, r.tries, r.reason) for k, r in rows.items()} == {
        "good": (200, 1, "ok"), "none": (200, 1, "no annotation"), "bare": (200, 1, "no pages"), "broken": (200, 1, "broken"), "denied": (403, 1, "status 403"), "busy": (503, 2, "status 503"), "gone": (503, 2, "status 503"),
    }
    assert sorted(r.image_id for r in rows.values()) == list(range(7)) and df.rdd.getNumPartitions() == 3
    found = recognise.letters(df.where("reason = 'ok'").select("image_id", "response")).collect()
    assert [(r.image_id, r.char) for r in found] == [(rows["good"].image_id, "a")]
    status = {r.image_id: r.status for r in recognise.response_status(df.where("response is not null").select("image_id", "response")).collect()}
    assert all(status[r.image_id] == r.reason for r in rows.values() if r.response is not None)


def test_navigation(spark):
    go = lambda seq, action, to=None, inked=True, session=1: (session, seq, action, to, inked)
    every = [go(k, "next", session=2) for k in range(50)]
    rows = [go(1, "next", inked=False), go(2, "skip"), go(3, "go", 1), go(4, "go", 5), go(5, None), go(6, "finish"), go(7, "next"), *every, go(1, "go", 42, session=3), go(2, "skip", session=3)]
    got = {(r.session_id, r.seq): (r.letter, r.drawn, r.over) for r in navigation.navigated(spark.createDataFrame(rows, "session_id long, seq long, action string, to int, inked boolean")).collect()}
    assert [got[1, k] for k in range(1, 8)] == [(0, 0, False), (1, 0, False), (1, 0, False), (5, 2, False), (5, 2, False), (5, 34, True), (5, 34, True)]
    assert [bin(got[2, k][1]).count("1") for k in range(43)] == list(range(1, 44)) and [k for k in range(50) if got[2, k][2]] == list(range(42, 50))
    assert got[2, 49][1] == (1 << len(LETTERS)) - 1 and got[3, 2] == (42, 1, True)


@pytest.mark.parametrize("w,h,tw,th", [(7, 5, 3, 2), (10, 10, 5, 5), (9, 4, 9, 3), (13, 17, 4, 16)])
def test_resampling_is_the_mean_of_what_a_pixel_covers(w, h, tw, th):
    px = np.random.default_rng(w).integers(0, 256, (h, w, 3)).astype(np.uint8)
    got = images.resampled(px, tw, th)
    for y in range(th):
        for x in range(tw):
            total = np.zeros(3)
            for v in range(h):
                for u in range(w):
                    part = max(0, min((x + 1) * w / tw, u + 1) - max(x * w / tw, u)) * max(0, min((y + 1) * h / th, v + 1) - max(y * h / th, v))
                    total += part * px[v, u]
            assert (np.abs(got[y, x] - total * tw * th / (w * h)) <= 0.5 + 1e-6).all()
    assert (images.resampled(np.full((h, w, 3), 77, np.uint8), tw, th) == 77).all()
    ramp = np.repeat(np.repeat(np.arange(0, 240, 20, dtype=np.uint8)[None, :, None], 4, 0), 3, 2)
    assert images.resampled(ramp, 6, 2)[0, :, 0].tolist() == [10, 50, 90, 130, 170, 210]


def outline_of(spark, points, size=8.0):
    df = spark.createDataFrame([(1, points)], "id int, points array<struct<x:double,y:double,pressure:double>>")
    smooth = df.select(o.smoothed(F.col("points"), size).alias("s")).first().s
    out = strokes.outlined(df, size).first().outline
    return smooth, None if out is None else np.array([(p.x, p.y) for p in out])


@pytest.mark.parametrize("seed", range(4))
def test_outlines_have_the_pressure_s_width_at_every_point(spark, seed):
    r = np.random.default_rng(seed)
    points = [(float(x), float(y), float(p)) for x, y, p in zip(np.cumsum(r.normal(0, 9, 90)), np.cumsum(r.normal(0, 9, 90)), r.random(90))]
    smooth, line = outline_of(spark, points)
    at = points[0][:2]
    for k, (p, want) in enumerate(zip(smooth, points)):
        at = want[:2] if not k else tuple(a + (b - a) * 0.49 for a, b in zip(at, want[:2]))
        assert math.dist((p.x, p.y), at) < 1e-9 and abs(p.r - 8 * (0.5 - 0.15 * (0.5 - want[2]))) < 1e-12
        off = np.hypot(*(line - at).T)
        assert (np.abs(off - p.r) < 1e-9).sum() >= 2


def test_outlines_of_odd_strokes(spark):
    assert outline_of(spark, [(1.0, 2.0, 0.5)])[1] is None
    still = outline_of(spark, [(1.0, 2.0, 0.5)] * 3)[1]
    assert len(still) == 12 and np.isfinite(still).all()
    straight = outline_of(spark, [(0.0, 0.0, 0.5), (10.0, 0.0, 0.5)])[1]
    assert straight.max(0).tolist() == [8.9, 4.0] and straight.min(0).tolist() == [-4.0, -4.0]
    back = outline_of(spark, [(0.0, 0.0, 0.5), (50.0, 0.0, 0.5), (0.0, 0.0, 0.5)])[1]
    assert len(back) == 6 + 6 + 3 + 3 and abs(back[:, 0].max() - 28.5) < 1e-9


def winding_number(x, y, chain):
    n = 0
    for (ax, ay), (bx, by) in zip(chain, chain[1:] + chain[:1]):
        if min(ay, by) <= y < max(ay, by) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
            n += 1 if by > ay else -1
    return n


@pytest.mark.parametrize("opacity", [1.0, 0.5])
def test_fills_follow_the_nonzero_rule(spark, opacity):
    r = random.Random(3)
    chains = [(c, t, [(r.uniform(-4, 20), r.uniform(-4, 14)) for _ in range(r.choice([1, 2, 3, 7, 15]))]) for c in (1, 2) for t in range(4)]
    chains.append((1, 9, [(2.5, 2.5), (8.5, 2.5), (8.5, 8.5), (2.5, 8.5)]))
    df = spark.createDataFrame(chains, "canvas int, turn int, points array<struct<x:double,y:double>>")
    ground = spark.createDataFrame([(1, 0, 0, 200), (1, 5, 5, 100), (3, 1, 1, 7)], "canvas int, x int, y int, g int")
    got = {(p.canvas, p.x, p.y): p.g for p in paint.painted(df, ["canvas"], 16, 10, opacity=opacity, background=ground).collect()}
    assert len(got) == 3 * 160
    under = {(1, 0, 0): 200, (1, 5, 5): 100, (3, 1, 1): 7}
    for (c, x, y), g in got.items():
        want = under.get((c, x, y), 255)
        for canvas, _, chain in chains:
            if canvas == c and winding_number(x + 0.5, y + 0.5, chain):
                want = 26 if opacity == 1.0 else math.floor(want + (26 - want) * opacity + 0.5)
        assert g == want


def test_pictures_read_back(spark):
    rows = [(s, letter, x, y, (7 * x + 11 * y + s) % 256) for s in (1, 2) for letter in "ab" for x in range(5) for y in range(3)]
    df = spark.createDataFrame(rows, "s int, letter string, x int, y int, g int")
    got = debugviz.png_pixels(debugviz.gray_png(df, ["s", "letter"]), ["s", "letter"])
    assert sorted((r.s, r.letter, r.x, r.y, r.g) for r in got.collect()) == sorted(rows)
    saved = spark.createDataFrame([(1, "a", 2, bytearray(b"new")), (1, "a", 1, bytearray(b"old"))], "session_id int, letter string, seq int, png binary")
    assert [bytes(r.png) for r in paint.kept(saved).collect()] == [b"new"]
    data = bytearray(debugviz.png(np.zeros((2, 2, 3), np.uint8)))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="broken"):
        debugviz.read_png(bytes(data))
