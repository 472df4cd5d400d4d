"""Encodings, names, origins and request validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest accepted base64 text.
MOST_BASE64 = 10 * 1024 * 1024


def base64_text(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), base64_text(data))


def data_url_parts(url: Column) -> Column:
    """(mime, payload) of a data URL; without a type it is image/png."""
    mime = F.nullif(F.regexp_extract(url, "^data:([^;,]*)", 1), F.lit(""))
    return F.struct(F.coalesce(mime, F.lit("image/png")).alias("mime"), F.regexp_extract(url, "^[^,]*,(.*)$", 1).alias("payload"))


def font_format(data: Column) -> Column:
    """woff2 by its magic number, else truetype, short data included."""
    return F.when(F.hex(F.substring(data, 1, 4)) == "774F4632", "woff2").otherwise("truetype")


def font_mime(kind: Column) -> Column:
    return F.when(kind == "woff2", "font/woff2").otherwise("font/sfnt")


def loaded_fonts(loads: DataFrame) -> DataFrame:
    """(family, format, url, css) of the fonts in use: of the loads (family, seq, font) of a family the last one."""
    last = loads.groupBy("family").agg(F.max_by("font", "seq").alias("font"))
    kind = font_format(F.col("font"))
    rows = last.withColumns({"format": kind, "url": data_url(font_mime(kind), F.col("font"))})
    return rows.select("family", "format", "url", font_css(F.col("family"), F.col("url"), F.col("format")).alias("css"))


def font_css(family: Column, url: Column, kind: Column) -> Column:
    return F.when(url.isNotNull(), F.format_string('@font-face { font-family: "%s"; src: url("%s") format("%s"); }', family, url, kind))


#: The characters that a browser trims and takes for blanks.
BLANKS = "[\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def file_name(name: Column) -> Column:
    """Lower case, blanks to hyphens, a to z, digits and hyphens alone; "you" where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trimmed(name)), BLANKS, "-"), "[^a-z0-9-]", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("you"))


def font_name(name: Column, key: Column, seed: int = 0) -> Column:
    """The name of an exported font, with a suffix from 100 to 999 drawn by the key and a seed."""
    return F.format_string("hand-of-%s-%d", file_name(name), seeded(key, seed, 900) + 100)


def seeded(key: Column, seed: int, n: int) -> Column:
    """A number below ``n`` drawn by the key and a seed, the same on every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % n).cast("int")


def date_slug(day: Column) -> Column:
    return F.concat(F.lower(F.date_format(day, "MMM")), F.day(day).cast("string"))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "green").when(confidence > 0.5, "yellow").otherwise("red")


def unique_letters(text: Column) -> Column:
    """The distinct letters a to z in order of first appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c.rlike("^[a-z]$")))


def palette(i: Column, s: float = 0.7, light: float = 0.55) -> Column:
    """(r, g, b) of the i-th label: hues a golden angle apart."""
    h = ((i * 137.508) % 360) / 360.0
    q = light * (1 + s) if light < 0.5 else light + s - light * s
    p = 2 * light - q

    def channel(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        v = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, F.lit(q)).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(F.lit(p))
        return F.floor(v * 255 + 0.5).cast("int")

    return F.struct(channel(h + 1 / 3).alias("r"), channel(h).alias("g"), channel(h - 1 / 3).alias("b"))


def origin_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), "^([a-z][a-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def allowed_origin(origin: Column, request_url: Column, app: str | None = None, development: bool = False) -> Column:
    """The origin if it may call: local ones in development, the app's own, the request's own; else null."""
    local = F.lit(development) & (origin.startswith("http://localhost:") | origin.startswith("http://127.0.0.1:"))
    own = (origin == F.lit(app)) if app else F.lit(False)
    return F.when(local | own | (origin == origin_of(request_url)), origin)


def cors_headers(allowed: Column) -> Column:
    """The headers of an answer to an allowed origin; empty for a refused one."""
    # Fixed values.
    pairs = {"Access-Control-Allow-Methods": "POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type", "Access-Control-Max-Age": "86400"}
    own = F.create_map(F.lit("Access-Control-Allow-Origin"), allowed, *(F.lit(x) for pair in pairs.items() for x in pair))
    return F.when(allowed.isNotNull(), own).otherwise(F.create_map().cast("map<string,string>"))


def with_cors(headers: Column, allowed: Column) -> Column:
    """``headers`` with those for the origin, which come before ones of the same name."""
    mine = cors_headers(allowed)
    return F.map_concat(F.map_filter(headers, lambda k, _: ~F.map_contains_key(mine, k)), mine)


def client_ip(forwarded: Column, real_ip: Column) -> Column:
    first = trimmed(F.split(forwarded, ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(real_ip, F.lit("")), F.lit("unknown"))


def looks_base64(text: Column) -> Column:
    """Not empty, no data URL, and only base64 characters among the first hundred."""
    return (F.length(text) > 0) & ~text.startswith("data:") & F.substring(text, 1, 100).rlike("^[A-Za-z0-9+/=]+$")


def validate_request(origin_refused: Column, limited: Column, keyed: Column, content_type: Column, body: Column, upstream: Column) -> Column:
    """(status, error) of a recognition request; the first check that fails decides."""
    parsed = F.from_json(body, "image STRING, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    image = F.coalesce(parsed["image"], F.lit(""))
    answer = lambda status, error: F.struct(F.lit(status).alias("status"), F.lit(error).alias("error"))
    return (
        F.when(origin_refused, answer(403, "origin"))
        .when(limited, answer(429, "rate"))
        .when(~keyed, answer(503, "key"))
        .when(~F.coalesce(content_type, F.lit("")).contains("application/json"), answer(415, "content type"))
        .when(parsed.isNull() | parsed["_broken"].isNotNull(), answer(400, "json"))
        .when(image == "", answer(400, "missing"))
        .when(F.length(image) > MOST_BASE64, answer(413, "size"))
        .when(~looks_base64(image), answer(400, "base64"))
        .when(upstream == 403, answer(502, "denied"))
        .when(upstream == 429, answer(429, "upstream rate"))
        .when(upstream != 200, answer(502, "upstream"))
        .otherwise(answer(200, None))
    )
