"""Glyph paths in font units, the glyph table of a font, and its encoding as an OpenType file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.functions.letters import ASCENDER, DESCENDER, EM, GUIDES, TARGET_HEIGHT, punctuation
from vellumspark.functions.svgpath import parse_path, path_box


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def font_coordinates(glyphs: DataFrame, reference: Column | None = None) -> DataFrame:
    """``glyphs`` (char, commands, ...) with ``commands`` in font units, ``advance`` and ``bearing``.

    Letters fill the em between descender and ascender; punctuation is scaled and raised by its
    metrics; with a ``reference`` height all but punctuation share one scale and keep their
    height on the canvas. Glyphs without commands or without width or height are dropped.
    """
    marks = punctuation(glyphs.sparkSession)
    df = glyphs.join(F.broadcast(marks), "char", "left")
    # The generator keeps the filter below from copying the parsing of paths into itself.
    once = F.inline(F.array(F.struct(F.col("commands"), path_box(F.col("commands")).alias("box"))))
    df = df.select(*(c for c in df.columns if c != "commands"), once)
    b = F.col("box")
    width, height = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    df = df.where((F.size("commands") > 0) & (F.coalesce(width, F.lit(1.0)) != 0) & (F.coalesce(height, F.lit(1.0)) != 0))
    mark = F.col("scale").isNotNull()
    reference = F.lit(None).cast("double") if reference is None else reference.cast("double")
    uniform = reference.isNotNull() & ~mark
    low, high = 1 - GUIDES["descender"], 1 - GUIDES["ascender"]
    scale = F.when(uniform, TARGET_HEIGHT / ((high - low) * reference)).otherwise(F.when(mark, TARGET_HEIGHT * F.col("scale")).otherwise(float(TARGET_HEIGHT)) / F.greatest(height, F.lit(1.0)))
    df = df.withColumns({"k": scale, "y0": F.when(uniform, low * reference).otherwise(b["min_y"]), "rise": DESCENDER + F.when(uniform, 0).otherwise(F.coalesce("y_offset", F.lit(0)))})
    df = df.withColumn("scaled", _round(width * F.col("k"))).withColumn("bearing", _round(F.col("scaled") * 0.12).cast("long"))

    def moved(p: Column) -> Column:
        x = lambda v: _round((v - F.col("box.min_x")) * F.col("k") + F.col("bearing")).cast("double")
        y = lambda v: _round((v - F.col("y0")) * F.col("k") + F.col("rise")).cast("double")
        return F.struct(p["type"].alias("type"), *(f(p[n]).alias(n) for n, f in (("x", x), ("y", y), ("x1", x), ("y1", y), ("x2", x), ("y2", y))))

    df = df.withColumn("advance", (F.col("scaled") + 2 * F.col("bearing")).cast("long")).withColumn("commands", F.transform("commands", moved))
    return df.select(*glyphs.columns, "advance", "bearing")


def glyph_commands(glyphs: DataFrame, paths: str = "paths") -> DataFrame:
    """``commands`` of all of a glyph's paths, one after the other."""
    return glyphs.withColumn("commands", F.flatten(F.transform(paths, parse_path)))


def glyph_table(glyphs: DataFrame, reference: Column | None = None) -> DataFrame:
    """(font_id, place, name, code, advance, commands): .notdef, space, then every character in order with
    its capital right after it where there is one."""
    made = font_coordinates(glyphs, reference)
    low, up = F.lower("char"), F.upper("char")
    first = F.row_number().over(W.partitionBy("font_id").orderBy("char")) == 1

    def row(char: Column, capital: int, name: Column, code: Column, advance: Column, commands: Column) -> Column:
        order = F.struct(char.alias("char"), F.lit(capital).alias("capital"))
        return F.struct(order.alias("order"), name.alias("name"), code.alias("code"), advance.cast("long").alias("advance"), commands.alias("commands"))

    none = F.array().cast(made.schema["commands"].dataType)
    rows = F.array(
        row(F.col("char"), 0, low, F.ascii(low), F.col("advance"), F.col("commands")),
        F.when(low != up, row(F.col("char"), 1, up, F.ascii(up), F.col("advance"), F.col("commands"))),
        F.when(F.col("first"), row(F.lit(""), 0, F.lit(".notdef"), F.lit(0), F.lit(600), parse_path(F.lit(NOTDEF_PATH)))),
        F.when(F.col("first"), row(F.lit(""), 1, F.lit("space"), F.lit(32), F.lit(EM // 4), none)),
    )
    return made.withColumn("first", first).select("font_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("font_id", "r.*")


# Fixed values. The box with a cut-out that stands for missing glyphs.
NOTDEF_PATH = "M100 0 L100 700 L500 700 L500 0 Z M150 50 L450 50 L450 650 L150 650 Z"


def _number(v: int) -> bytes:
    """An operand of a charstring or dictionary."""
    if -107 <= v <= 107:
        return bytes([v + 139])
    if 108 <= v <= 1131:
        return bytes([(v - 108 >> 8) + 247, v - 108 & 255])
    if -1131 <= v <= -108:
        return bytes([(-v - 108 >> 8) + 251, -v - 108 & 255])
    return b"\x1c" + struct.pack(">h", v)


class Commands(NamedTuple):
    """The commands of glyphs, one after the other: ``sizes`` of each glyph, then one array a field; what is missing is NaN."""

    sizes: np.ndarray
    type: np.ndarray
    points: dict[str, np.ndarray]


#: Fields of a command in the order in which curves draw them.
AXES = ("x1", "y1", "x2", "y2", "x", "y")


def commands_of(column: pa.Array) -> Commands:
    """The commands of a list column of structs."""
    flat = column.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten()))
    points = {k: fields[k].cast(pa.float64()).to_numpy(zero_copy_only=False) for k in AXES}
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    kinds = fields["type"].dictionary_encode()
    names = np.array([k or "N" for k in kinds.dictionary.to_pylist()] or ["N"], "U1")
    return Commands(sizes, names[kinds.indices.fill_null(0).to_numpy()], points)


def _near(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), -16_000, 16_000)


def charstrings(advances: np.ndarray, commands: Commands) -> list[bytes]:
    """Type 2 charstrings of glyphs; quadratic curves become the equal cubic ones. Numbers stay within the format's
    16 bits: coordinates beyond 16,000 units and advances beyond 32,000 are drawn at that bound."""
    glyph = np.repeat(np.arange(len(commands.sizes)), commands.sizes)
    drawn = (commands.type != "Z") & ~np.isnan(commands.points["x"]) & ~np.isnan(commands.points["y"])
    glyph, kind, p = glyph[drawn], commands.type[drawn], {k: v[drawn] for k, v in commands.points.items()}
    curve, square = np.isin(kind, ("C", "Q")), kind == "Q"
    for at in "xy":
        end = _near(p[at])
        before = np.concatenate([[0.0], end[:-1]])
        before[np.concatenate([[True], glyph[1:] != glyph[:-1]])[: len(before)]] = 0.0
        control = p[at + "1"]
        p[at + "1"] = np.where(square, (before[: len(end)] + 2 * control) / 3, control)
        p[at + "2"] = np.where(square, (p[at] + 2 * control) / 3, p[at + "2"])
    # Every command's points: two controls before the end where it curves.
    n = np.where(curve, 3, 1)
    first, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    steps = np.empty((len(owner), 2))
    for k, at in enumerate("xy"):
        steps[first + n - 1, k] = _near(p[at])
        for part in (1, 2):
            steps[first[curve] + part - 1, k] = _near(p[f"{at}{part}"][curve])
    steps = steps.astype(np.int64)
    moved = np.diff(steps, axis=0, prepend=np.zeros((1, 2), np.int64))
    start = np.concatenate([[True], glyph[owner][1:] != glyph[owner][:-1]])[: len(owner)]
    moved[start] = steps[start]
    # The tokens of a glyph: advance, of each command its numbers and operator, the end.
    tokens = 2 * n + 1
    glyph_tokens = 2 + np.bincount(glyph, weights=tokens, minlength=len(commands.sizes)).astype(np.int64)
    glyph_at = np.cumsum(glyph_tokens) - glyph_tokens
    command_at = np.cumsum(tokens) - tokens + 1 + 2 * glyph
    value, operator = np.empty(int(glyph_tokens.sum()), np.int64), np.zeros(int(glyph_tokens.sum()), bool)
    value[glyph_at], value[glyph_at + glyph_tokens - 1] = np.minimum(advances, 32_000), 0x0E
    at = command_at[owner] + 2 * (np.arange(len(owner)) - first[owner])
    value[at], value[at + 1] = moved[:, 0], moved[:, 1]
    value[command_at + tokens - 1] = np.where(kind == "M", 0x15, np.where(curve, 0x08, 0x05))
    operator[glyph_at + glyph_tokens - 1] = operator[command_at + tokens - 1] = True
    data, ends = _numbers(value, operator)
    bounds = np.concatenate([[0], ends])[np.append(glyph_at, len(value))]
    return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _numbers(value: np.ndarray, operator: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Operands and operators as bytes, and where each ends; the forms are those of ``_number``."""
    size = np.abs(value)
    length = np.where(operator | (size <= 107), 1, np.where(size <= 1131, 2, 3))
    ends = np.cumsum(length)
    at, out = ends - length, np.zeros(int(length.sum()), np.uint8)
    one, two, three = length == 1, length == 2, length == 3
    out[at[one]] = np.where(operator[one], value[one], value[one] + 139)
    rest = size[two] - 108
    out[at[two]], out[at[two] + 1] = (rest >> 8) + np.where(value[two] > 0, 247, 251), rest & 255
    out[at[three]], out[at[three] + 1], out[at[three] + 2] = 28, value[three] >> 8 & 255, value[three] & 255
    return out.tobytes(), ends


def _index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    offsets = 1 + np.cumsum([0, *map(len, items)])
    return struct.pack(">HB", len(items), 4) + offsets.astype(">u4").tobytes() + b"".join(items)


def _cff(name: str, names_of: list[str], drawings: list[bytes]) -> bytes:
    strings = [n.encode() for n in names_of[1:]]
    wide = lambda v: b"\x1d" + struct.pack(">i", v)
    head, names = b"\x01\0\x04\x04", _index([name.encode()])
    tail = _index(strings) + _index([])
    top_size = len(_index([b"".join((wide(0), b"\x0f", wide(0), b"\x11", wide(0), wide(0), b"\x12"))]))
    charset_at = len(head) + len(names) + top_size + len(tail)
    charset = b"\0" + (391 + np.arange(len(strings))).astype(">u2").tobytes()
    chars = _index(drawings)
    private = _number(0) + b"\x14" + _number(0) + b"\x15"
    at = charset_at + len(charset)
    top = _index([b"".join((wide(charset_at), b"\x0f", wide(at), b"\x11", wide(len(private)), wide(at + len(chars)), b"\x12"))])
    return head + names + top + tail + charset + chars + private


def _cmap(codes: list[tuple[int, int]]) -> bytes:
    """A format 4 table, one segment per code."""
    code, glyph = np.array([*codes, (0xFFFF, 0x10000)]).T
    n = len(code)
    power = 1 << n.bit_length() - 1
    wide = lambda v: v.astype(">u2").tobytes()
    body = struct.pack(">4H", 2 * n, 2 * power, power.bit_length() - 1, 2 * (n - power))
    body += wide(code) + b"\0\0" + wide(code) + wide(glyph - code & 0xFFFF) + b"\0\0" * n
    return struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHH", 4, len(body) + 6, 0) + body


@lru_cache(maxsize=16)
def _names(family: str) -> bytes:
    texts = {1: family, 2: "Regular", 3: f"{family} Regular", 4: f"{family} Regular", 6: f"{family}-Regular".replace(" ", "")}
    data, rows = b"", b""
    for number, text in texts.items():
        coded = text.encode("utf-16-be")
        rows += struct.pack(">6H", 3, 1, 0x409, number, len(coded), len(data))
        data += coded
    return struct.pack(">3H", 0, len(texts), 6 + len(rows)) + rows + data


def encode_font(family: str, names: list[str], glyph_codes: list[int], advances: np.ndarray, drawings: list[bytes], bounds: tuple[int, int, int, int]) -> bytes:
    """An OpenType file of glyphs, .notdef first, from their charstrings; ``bounds`` (least x and y, greatest x and y) holds all their points."""
    x1, y1, x2, y2 = bounds
    clip = lambda v: max(-32768, min(32767, v))
    box = struct.pack(">4h", *map(clip, (x1, y1, x2, y2)))
    advances = np.minimum(advances, 32_000)
    widest = int(advances.max())
    codes = sorted({c: i for i, c in reversed(list(enumerate(glyph_codes))) if c}.items())
    os2 = struct.pack(">HhHHH10hh", 3, widest // 2, 400, 5, 0, *[0] * 11) + bytes(10) + struct.pack(">4I", 1, 0, 0, 0) + b"    "
    os2 += struct.pack(">HHHhhhHH", 64, codes[0][0], codes[-1][0], ASCENDER, DESCENDER, 0, ASCENDER, -DESCENDER) + struct.pack(">IIhhHHH", 1, 0, 500, 700, 0, 32, 1)
    tables = {
        b"CFF ": _cff(family.replace(" ", ""), names, drawings),
        b"OS/2": os2,
        b"cmap": _cmap(codes),
        b"head": struct.pack(">IIIIHHqq", 0x10000, 0x10000, 0, 0x5F0F3CF5, 3, EM, 0, 0) + box + struct.pack(">HHhhh", 0, 8, 2, 0, 0),
        b"hhea": struct.pack(">IhhhHhhhhhhhhhhhH", 0x10000, ASCENDER, DESCENDER, 0, widest, 0, 0, clip(x2), 1, 0, 0, 0, 0, 0, 0, 0, len(names)),
        b"hmtx": np.stack([advances, np.zeros_like(advances)], axis=1).astype(">u2").tobytes(),
        b"maxp": struct.pack(">IH", 0x5000, len(names)),
        b"name": _names(family),
        b"post": struct.pack(">IIhhIIIII", 0x30000, 0, -75, 50, 0, 0, 0, 0, 0),
    }
    n = len(tables)
    power = 1 << n.bit_length() - 1
    at = 12 + 16 * n
    head, data = b"OTTO" + struct.pack(">4H", n, 16 * power, power.bit_length() - 1, 16 * (n - power)), b""
    for tag, table in tables.items():
        padded = table + bytes(-len(table) % 4)
        total = int(np.frombuffer(padded, ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF
        head += tag + struct.pack(">3I", total, at + len(data), len(table))
        data += padded
    return head + data


def read_font(data: bytes) -> dict:
    """Metrics, code map, advances and tables of an OpenType file."""
    n = struct.unpack(">H", data[4:6])[0]
    tables = {}
    for k in range(n):
        tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
        tables[tag.decode()] = data[at : at + size]
    count = struct.unpack(">H", tables["maxp"][4:6])[0]
    sub = tables["cmap"][struct.unpack(">I", tables["cmap"][8:12])[0] :]
    segments = struct.unpack(">H", sub[6:8])[0] // 2
    part = lambda k, extra=0: struct.unpack(f">{segments}H", sub[14 + 2 * segments * k + extra : 14 + 2 * segments * (k + 1) + extra])
    codes = {a: a + d & 0xFFFF for a, d in zip(part(1, 2), part(2, 2)) if a != 0xFFFF}
    advances = [struct.unpack(">H", tables["hmtx"][4 * k : 4 * k + 2])[0] for k in range(count)]
    ascender, descender = struct.unpack(">hh", tables["hhea"][4:8])
    return {"em": struct.unpack(">H", tables["head"][18:20])[0], "ascender": ascender, "descender": descender, "codes": codes, "advances": advances, "tables": tables}


def _items(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entries of an index that begins at ``at``, and where it ends."""
    n = struct.unpack(">H", data[at : at + 2])[0]
    if not n:
        return [], at + 2
    size = data[at + 2]
    offsets = [int.from_bytes(data[at + 3 + size * k : at + 3 + size * (k + 1)], "big") for k in range(n + 1)]
    base = at + 2 + size * (n + 1)
    return [data[base + a : base + b] for a, b in zip(offsets[:-1], offsets[1:])], base + offsets[-1]


def _operands(data: bytes, wide: int | None = None):
    """(operator, operands before it) of a charstring, or of a dictionary if ``wide`` tells its byte for 32-bit numbers."""
    held, at = [], 0
    while at < len(data):
        b = data[at]
        if b >= 32 or b == 28 or b == wide:
            form = 1 if 32 <= b <= 246 else 2 if 247 <= b <= 254 else 3 if b == 28 else 5
            part = data[at : at + form]
            held.append(b - 139 if form == 1 else (b - 247) * 256 + part[1] + 108 if b <= 250 and form == 2 else -(b - 251) * 256 - part[1] - 108 if form == 2 else int.from_bytes(part[1:], "big", signed=True))
            at += form
        else:
            yield b, held
            held, at = [], at + 1


#: Bytes of the token that a byte of a charstring begins; operators are one byte.
FORMS = np.array([1] * 28 + [3] + [1] * 218 + [2] * 8 + [5])


class Outlines(NamedTuple):
    """Commands of glyphs, one after the other: ``sizes`` of each glyph, then the operator of each command and the point it ends in."""

    sizes: np.ndarray
    operator: np.ndarray
    x: np.ndarray
    y: np.ndarray


def drawings_of(cff: bytes) -> tuple[int, np.ndarray]:
    """Where the charstrings of a CFF table begin, and their offsets from there, the last one's end included."""
    _, at = _items(cff, cff[2])
    (top,), _ = _items(cff, at)
    (at,) = next(operands for operator, operands in _operands(top, 29) if operator == 17)
    n, size = struct.unpack(">HB", cff[at : at + 3])
    raw = np.frombuffer(cff, np.uint8, size * (n + 1), at + 3).reshape(-1, size).astype(np.int64)
    return at + 2 + size * (n + 1), raw @ 256 ** np.arange(size - 1, -1, -1)


def outlines(drawings: bytes, starts: np.ndarray) -> Outlines:
    """The commands of charstrings that follow each other in ``drawings``; ``starts`` has where each begins, none of them empty.

    A byte is where a token begins if it is a glyph's first or follows a token; following twice as many at each round finds them all.
    """
    raw = np.frombuffer(drawings, np.uint8).astype(np.int64)
    n = len(raw)
    follows = np.append(np.minimum(np.arange(n) + FORMS[raw], n), n)
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    for _ in range(int(np.diff(starts, append=n).max(initial=1)).bit_length()):
        begins[follows[begins]] = True
        follows = follows[follows]
    at = np.flatnonzero(begins[:n])
    first = raw[at]
    form, second = FORMS[first], np.append(raw, [0] * 4)[at + 1]
    value = np.where(form == 1, first - 139, np.where(first <= 250, (first - 247) * 256 + second + 108, -(first - 251) * 256 - second - 108))
    for length in (3, 5):
        some = at[form == length]
        number = sum(raw[some + k] << 8 * (length - 1 - k) for k in range(1, length))
        value[form == length] = number - (number >> 8 * (length - 1) - 1 << 8 * (length - 1))
    operator = (first < 32) & (first != 28)
    value[operator] = 0
    draws = np.flatnonzero(operator & np.isin(first, (21, 5, 8)))
    kind = first[draws]
    value = np.append(value, [0] * 6)  # so that what lies before the first token is 0
    moves = [np.where(kind == 8, value[draws - k], 0) if k > 2 else value[draws - k] for k in range(1, 7)]
    glyph = np.searchsorted(starts, at[draws], "right") - 1
    sizes = np.bincount(glyph, minlength=len(starts))
    base = np.cumsum(sizes) - sizes

    def summed(steps: np.ndarray) -> np.ndarray:
        up_to = np.append(0, np.cumsum(steps))
        return up_to[1:] - np.repeat(up_to[base], sizes)

    return Outlines(sizes, kind, summed(moves[1] + moves[3] + moves[5]), summed(moves[0] + moves[2] + moves[4]))


#: The letters of the operators that draw.
DRAWS = {21: "M", 5: "L", 8: "C"}


def read_outlines(data: bytes) -> list[list[tuple[str, int, int]]]:
    """The commands M, L and C of every glyph of a file, with the points they end in, from its charstrings."""
    cff = read_font(data)["tables"]["CFF "]
    base, offsets = drawings_of(cff)
    found = outlines(cff[base + offsets[0] : base + offsets[-1]], offsets[:-1] - offsets[0])
    steps = list(zip((DRAWS[k] for k in found.operator.tolist()), found.x.tolist(), found.y.tolist()))
    ends = np.cumsum(found.sizes).tolist()
    return [steps[a:b] for a, b in zip([0, *ends[:-1]], ends)]


#: A drawn glyph on its way into a font: the character, its names and codes, and what its commands become.
GLYPH = "char string, name string, code int, capital_name string, capital_code int, advance long, drawing binary, x1 double, y1 double, x2 double, y2 double"


def drawn(glyphs: DataFrame) -> DataFrame:
    """(font_id, GLYPH) of glyphs (font_id, char, ..., advance, commands): charstrings and the bounds of their points, many glyphs at a time."""
    low, up = F.lower("char"), F.upper("char")
    own = ["font_id", "char", "name", "code", "capital_name", "capital_code", "advance"]
    capital = low != up
    rows = glyphs.select(F.col("font_id").cast("long"), "char", low.alias("name"), F.ascii(low).alias("code"), F.when(capital, up).alias("capital_name"), F.when(capital, F.ascii(up)).alias("capital_code"), F.col("advance").cast("long"), "commands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                commands = commands_of(batch.column("commands"))
                made = charstrings(batch.column("advance").to_numpy(), commands)
                columns = [*(batch.column(c) for c in own), pa.array(made, pa.binary()), *(pa.array(v, from_pandas=True) for v in bounds_of(commands))]
                yield pa.RecordBatch.from_arrays(columns, [*own, "drawing", "x1", "y1", "x2", "y2"])

    return rows.mapInArrow(run, f"font_id long, {GLYPH}")


def bounds_of(commands: Commands) -> list[np.ndarray]:
    """Of each glyph the least x and y and the greatest x and y of its points; NaN without any."""
    glyph, out = np.repeat(np.arange(len(commands.sizes)), commands.sizes), []
    for most in (np.fmin, np.fmax):
        for at in "xy":
            found = np.full(len(commands.sizes), np.nan)
            most.at(found, glyph, most(most(commands.points[at], commands.points[at + "1"]), commands.points[at + "2"]))
            out.append(found)
    return out


@lru_cache(maxsize=1)
def fixed_glyphs() -> tuple[list[tuple[str, int, int, bytes]], tuple[int, int, int, int]]:
    """(name, code, advance, charstring) of .notdef and space, and the bounds of the former's points."""
    points = [tuple(map(int, step.split())) for step in NOTDEF_PATH.replace("Z", "").replace("M", "|").replace("L", "|").split("|")[1:]]
    kinds = np.array(["M", "L", "L", "L"] * 2, "U1")
    x, y = np.array(points, float).T
    none = np.full(len(x), np.nan)
    box, blank = charstrings(np.array([600, EM // 4]), Commands(np.array([len(x), 0]), kinds, {"x": x, "y": y} | {k: none for k in AXES[:4]}))
    return [(".notdef", 0, 600, box), ("space", 32, EM // 4, blank)], (int(x.min()), int(y.min()), int(x.max()), int(y.max()))


def made_fonts(glyphs: DataFrame, reference: Column | None = None, family: str = "MyHandwriting") -> DataFrame:
    """(font_id, font, n_glyphs, chars) from glyphs (font_id, char, commands): the fonts that ``fonts`` makes of their glyph table.

    Glyphs are encoded where they are, so what is dealt by font and sorted are charstrings and not commands; a task streams
    its sorted rows and holds a block of them and one font.
    """
    rows = drawn(font_coordinates(glyphs, reference)).repartition("font_id").sortWithinPartitions("font_id", "char", "advance", "drawing")
    return rows.mapInArrow(lambda batches: assembled(batches, family), "font_id long, font binary, n_glyphs long, chars string")


def assembled(batches: Iterator[pa.RecordBatch], family: str) -> Iterator[pa.RecordBatch]:
    """The fonts of rows (font_id, GLYPH) that are sorted by font and character."""
    kinds = {"font_id": pa.int64(), "font": pa.binary(), "n_glyphs": pa.int64(), "chars": pa.string()}
    held: list[dict] = []

    def made(rows: list[dict]) -> tuple:
        fixed, (x1, y1, x2, y2) = fixed_glyphs()
        table = list(fixed)
        for r in rows:
            table.append((r["name"], r["code"], r["advance"], r["drawing"]))
            if r["capital_name"] is not None:
                table.append((r["capital_name"], r["capital_code"], r["advance"], r["drawing"]))
        least = [int(min([v, *(r[k] for r in rows if r[k] is not None)])) for k, v in (("x1", x1), ("y1", y1))]
        most = [int(max([v, *(r[k] for r in rows if r[k] is not None)])) for k, v in (("x2", x2), ("y2", y2))]
        names, codes, advances, drawings = map(list, zip(*table))
        data = encode_font(family, names, codes, np.array(advances), drawings, (*least, *most))
        return rows[0]["font_id"], data, len(names), "".join(sorted({r["name"] for r in rows}))

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*done), kinds.values())], list(kinds))

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if held and held[0]["font_id"] != row["font_id"]:
                done.append(made(held))
                held = []
            held.append(row)
        if done:
            yield batch_of(done)
    if held:
        yield batch_of([made(held)])


def fonts(table: DataFrame, family: str = "MyHandwriting") -> DataFrame:
    """(font_id, font, n_glyphs, chars) from a glyph table; a font's few glyphs meet in one task."""

    def build(group: pa.Table) -> pa.Table:
        order = group["order"].combine_chunks().flatten()
        capital = order[1].to_numpy()
        by = np.lexsort((capital, np.array(order[0].to_pylist(), "U8")))
        rows = group.take(pa.array(by)).combine_chunks()
        names, advances = rows["name"].to_pylist(), rows["advance"].to_numpy()
        commands = commands_of(rows["commands"].chunk(0))
        bounds = [int(v) if v == v else 0 for v in (f(b) for f, b in zip((np.fmin.reduce, np.fmin.reduce, np.fmax.reduce, np.fmax.reduce), bounds_of(commands)))]
        data = encode_font(family, names, rows["code"].to_pylist(), advances, charstrings(advances, commands), bounds)
        chars = sorted({name for name, c in zip(names[2:], capital[by][2:].tolist()) if c == 0})
        return pa.table({"font_id": rows["font_id"][:1], "font": pa.array([data], pa.binary()), "n_glyphs": pa.array([len(names)], pa.int64()), "chars": pa.array(["".join(chars)])})

    return table.withColumn("font_id", F.col("font_id").cast("long")).groupBy("font_id").applyInArrow(build, "font_id long, font binary, n_glyphs long, chars string")
