"""Steps that must grow no faster than their input: what they deal and hold, and that their results are those of the plain forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumspark import queries
from vellumspark.functions.svgpath import parse_path
from vellumspark.operators import curves, debugviz, font, paths, trace
from vellumspark.sinks import files

ODD = [
    None, "", "   ", "Z", "12 13", "M1 2", "m1,2-3-4l5", "M0 0h5v-5H1V1z", "M1 1 2 2 3", "q1 2 3 4C1 2 3 4 5 6 7", "c1 2 3 4 5 6l1", "S1 2 3 4T1 2A1 2 3M7 7L8 8", "M1e2 1E-1L.5-.5", "M1e999 2L3 4l1 1", "M1\n2\tL3 4\x005Z",
    "M1 L2 3l4 5V7l1 1", "M" + " L".join(f"{i} {i % 7}" for i in range(200)) + "Z", "v", "h1 2 3v4", "Q1 2 3 4 5 6", "M1.5.5 2..3L-1-1", "é M1 2 ß L3 4",
]


def test_paths_of_a_batch_are_those_of_the_fold(spark):
    dice = random.Random(1)
    drawn = ["".join(dice.choice("MmLlHhVvCcQqZzSsTtAa") + " ".join(str(dice.choice([dice.randint(-9, 9), dice.random(), "1e2", "-.5"])) for _ in range(dice.randint(0, 9))) for _ in range(dice.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(ODD + drawn)), "k int, d string")
    got = {r.k: r.commands for r in paths.parsed_paths(df).collect()}
    assert got == {r.k: r.commands for r in df.select("k", parse_path(F.col("d")).alias("commands")).collect()}
    assert got[0] is None and got[1] == []


def test_fonts_from_glyphs_are_those_of_the_glyph_table(spark, sf_dir):
    glyphs = queries.lettered(spark, sf_dir).where("font_id < 8 or path_id % 5 = 0")
    made = font.made_fonts(glyphs)
    plain = {r.font_id: r for r in font.fonts(font.glyph_table(glyphs)).collect()}
    assert {r.font_id: r for r in made.collect()} == plain
    # Commands are encoded before rows are dealt by font: nothing numbers them in a window.
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    read = {}
    for r in queries.outline_points(made).collect():
        read.setdefault((r.font_id, r.code), []).append((r.i, r.type, r.x, r.y))
    for i, r in plain.items():
        steps = font.read_outlines(bytes(r.font))
        for code, glyph in font.read_font(bytes(r.font))["codes"].items():
            assert sorted(read.get((i, code), [])) == [(k, *s) for k, s in enumerate(steps[glyph])]


def test_charstrings_are_read_as_numbers_are_written():
    values = [0, 1, -107, 107, 108, -108, 1131, -1131, 1132, -1132, 32_000, -32_000]
    code = lambda *v: b"".join(map(font._number, v))
    glyphs = [b"\x0e", code(500, *values[:2]) + b"\x15" + b"".join(code(a, b) + b"\x05" for a in values for b in values[:3]) + b"\x0e", code(600, 3, 4) + b"\x15" + code(*values[4:10]) + b"\x08\x0e"]
    found = font.outlines(b"".join(glyphs), np.cumsum([0, *map(len, glyphs[:-1])]))
    assert found.sizes.tolist() == [0, 37, 2]
    x, y = [0], [1]
    for a in values:
        for b in values[:3]:
            x.append(x[-1] + a)
            y.append(y[-1] + b)
    assert (found.x[:37].tolist(), found.y[:37].tolist()) == (x, y)
    assert (found.x[37], found.y[37], found.x[38], found.y[38]) == (3, 4, 3 + 108 + 1131 + 1132, 4 - 108 - 1131 - 1132)


def test_readers_hold_few_fonts_at_a_time(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "AT_ONCE", 2)
    made = font.made_fonts(queries.lettered(spark, sf_dir))
    n = {r.font_id: r.n_glyphs for r in made.collect()}
    codes = queries.decoded(made)
    assert {r.font_id: r.n for r in codes.groupBy("font_id").agg((F.count("*") + 1).alias("n")).collect()} == n


def test_straight_parts_of_many_points_are_those_of_each():
    y, x = np.mgrid[:60, :60]
    for ink in ((x - 30) ** 2 + (y - 28) ** 2 < 600, abs(x - y) < 9, np.random.default_rng(4).random((12, 12)) < 0.6):
        for path in trace.outline(ink, minority=True):
            lattice = curves.Lattice(path)
            ends, j, cost = curves.straight(lattice, np.arange(len(lattice.p) - 1))
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                _, own, own_cost = curves.straight(lattice, np.array([i]))
                assert (j[a:b] == own).all() and (cost[a:b] == own_cost).all() and own[0] == i + 1


def test_pictures_are_drawn_a_batch_at_a_time(spark, sf_dir):
    made = debugviz.boxes_png(queries.small_ink(spark, sf_dir), queries.quadrants(spark, sf_dir))
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.where("png is null").count() == 0


def test_files_are_moved_and_read_by_tasks_and_listed_nowhere(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HELD", 3)
    monkeypatch.setattr(files, "DEALT", 5)
    at, want = f"file://{tmp_path}/o", {f"{k % 2}/_{k}.bin": b"x" * k for k in range(50)}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in want.items()], "n string, d binary")
    written = files.write_files(df, at, F.col("n"), F.col("d"))
    assert sorted(r["name"] for r in written.collect()) == sorted(want) == sorted(str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").rglob("*") if p.is_file())
    monkeypatch.setattr(files, "AT_ONCE", 40)
    read = files.read_files(spark, at, written)
    assert {r["name"]: bytes(r.content) for r in read.collect()} == {n: b for n, b in want.items() if b}
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and read.rdd.getNumPartitions() == 10
    assert not [p for p in (tmp_path / "o").iterdir() if p.name not in "01"]
    none = files.write_files(df.where("n = 'z'"), f"file://{tmp_path}/none", F.col("n"), F.col("d"))
    assert files.read_files(spark, f"file://{tmp_path}/none", none).collect() == []


def test_moves_that_are_repeated_change_nothing(tmp_path):
    at = f"file://{tmp_path}/o"
    writer = files.file_source()({"path": at, "job": "j"}).writer(None, False)
    done = writer.write(iter([("a.bin", b"1"), ("d/b.bin", b"2")]))
    lost = writer.write(iter([("a.bin", b"old")]))
    writer.commit([done])
    assert [p.name for p in (tmp_path / "o" / "_staging-j" / "counted").iterdir()] == [f"{done.attempt}.parquet"] and not (tmp_path / "o" / "a.bin").exists()
    rows = lambda *names: iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array([done.attempt] * len(names))], ["name", "attempt"])])
    for names in (("a.bin",), ("a.bin", "d/b.bin"), ("a.bin", "d/b.bin")):
        assert [b.column(0).to_pylist() for b in files.moved(at, "j", rows(*names))] == [list(names)]
    with pytest.raises(OSError):
        list(files.moved(at, "j", rows("c.bin")))
    files.clean(at, "j")
    assert lost.n == 1 and {str(p.relative_to(tmp_path / "o")): p.read_bytes() for p in (tmp_path / "o").rglob("*") if p.is_file()} == {"a.bin": b"1", "d/b.bin": b"2"}


@pytest.mark.parametrize("name", ["debug_files", "file_sink"])
def test_queries_read_their_files_by_name(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "RepartitionByExpression [name#" in plan
