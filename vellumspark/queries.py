"""Registry of the engine's queries: name to callable, and name to the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.functions import letters as L
from vellumspark.functions import outline as stroke_outlines
from vellumspark.functions import svgpath, web
from vellumspark.operators import components, debugviz, font, limiter, match, navigation, paint, paths, raster, recognise, strokes, trace
from vellumspark.oracle import SQL
from vellumspark.plans import drawing, pangram, photo
from vellumspark.session import scratch_dir
from vellumspark.sinks import files, sessions
from vellumspark.sources import images, tables
from vellumspark.sources.tables import table
from vellumspark.streaming.stateful import limited_stream, stroke_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Ink of the small rasters: levels below this.
CUT = 110
#: The limiter's queries: a window of a day and two requests, so that some are denied.
DAY, TWO = 86_400_000_000, 2


def small_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.small_rasters(spark, sf_dir).select("image_id", "x", "y", F.when(F.col("g") < CUT, 255).otherwise(0).alias("ink"))


def gray_luma(spark, sf_dir):
    return raster.grayscale(tables.colour_rasters(spark, sf_dir))


def raster_invert(spark, sf_dir):
    return raster.inverted(tables.small_rasters(spark, sf_dir))


def raster_blur5x5(spark, sf_dir):
    return raster.blur(tables.small_rasters(spark, sf_dir))


def adaptive_threshold(spark, sf_dir):
    return raster.adaptive_threshold(tables.sheets(spark, sf_dir))


def histogram256(spark, sf_dir):
    return raster.histogram(tables.small_rasters(spark, sf_dir))


def otsu_threshold(spark, sf_dir):
    return raster.otsu(tables.small_rasters(spark, sf_dir))


def dilate_3x3(spark, sf_dir):
    return raster.dilate(small_ink(spark, sf_dir))


def erode_3x3(spark, sf_dir):
    return raster.erode(small_ink(spark, sf_dir))


def close_3x3(spark, sf_dir):
    return raster.close(small_ink(spark, sf_dir))


def close_2x2_identity(spark, sf_dir):
    return raster.close(small_ink(spark, sf_dir), width=2, height=2)


def component_stats(spark, sf_dir):
    return components.component_stats(components.label_map(small_ink(spark, sf_dir)))


def component_label_map(spark, sf_dir):
    return components.valid_label_map(components.label_map(small_ink(spark, sf_dir)), 3)


def remove_small_components(spark, sf_dir):
    return components.remove_small(small_ink(spark, sf_dir), 3)


def component_neighbours(spark, sf_dir):
    return components.neighbours(small_ink(spark, sf_dir))


def ink_bounds(spark, sf_dir):
    return raster.ink_bounds(small_ink(spark, sf_dir))


def single_glyph_center(spark, sf_dir):
    """Every ninth raster is blank."""
    ink = F.when(F.col("image_id") % 9 == 0, 0).otherwise(F.col("ink"))
    return raster.centred_glyph(small_ink(spark, sf_dir).withColumn("ink", ink))


def photo_preprocess(spark, sf_dir):
    """The sheets of drawing a photo would give, with components from 5 pixels kept: their ink is sparse."""
    return photo.photo_ink(tables.sheets(spark, sf_dir), least_area=5)


def glyph_preprocess(spark, sf_dir):
    return photo.glyph_ink(tables.small_rasters(spark, sf_dir))


def recognized_first_letters(spark, sf_dir):
    return recognise.letters(tables.recognition_json(spark, sf_dir))


def recognition_status(spark, sf_dir):
    """Some responses are broken, without annotation or without pages."""
    k = F.col("image_id") % 5
    spoiled = F.when(k == 0, "{oops").when(k == 1, '{"responses":[{}]}').when(k == 2, '{"responses":[{"fullTextAnnotation":{"text":"","pages":[]}}]}').otherwise(F.col("response"))
    return recognise.response_status(tables.recognition_json(spark, sf_dir).withColumn("response", spoiled))


def label_counts(spark, sf_dir):
    return components.label_counts(components.label_map(small_ink(spark, sf_dir)), 3)


def font_registry(spark, sf_dir):
    """Documents as fonts loaded under a family by language and source, one over the other."""
    k = F.col("doc_id")
    data = F.encode(F.concat(F.when(k % 3 == 0, "wOF2").otherwise("true"), F.md5(k.cast("string"))), "UTF-8")
    family = F.concat_ws("-", F.coalesce("lang", F.lit("none")), (k % 4).cast("string"))
    found = web.loaded_fonts(table(spark, sf_dir, "documents").select(family.alias("family"), k.alias("seq"), data.alias("font")))
    return found.select("family", "format", F.md5("url").alias("url_md5"), F.md5("css").alias("css_md5"))


def unique_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(web.unique_letters(F.col("text")), "").alias("chars"))


def pangram_coverage(spark, sf_dir):
    """The letters that each session's pangram asks for, and how many of them it has drawn."""
    k = F.col("session_id")
    done = drawn(spark, sf_dir).join(F.broadcast(L.letters(spark)), "place").groupBy(k).agg(F.collect_set("letter").alias("have"))
    asked = done.withColumn("pangram_id", web.seeded(k, 1, len(L.PANGRAMS))).join(F.broadcast(L.pangrams(spark)), "pangram_id")
    chars = asked.select(k, "pangram_id", "have", web.unique_letters(F.col("text")).alias("chars"))
    return chars.select(k, "pangram_id", F.array_join("chars", "").alias("chars"), F.size("chars").alias("n"), F.size(F.array_intersect("chars", "have")).alias("drawn"))


def letter_categories(spark, sf_dir):
    """How often the letters to draw occur in the parts' names, with the guide line of each."""
    guide = F.when(F.col("category") == "ascender", L.GUIDES["ascender"]).when(F.col("category") == "descender", L.GUIDES["descender"]).otherwise(L.GUIDES["xHeight"])
    seen = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return seen.join(F.broadcast(L.letters(spark)), "letter").select("place", "letter", "category", guide.alias("guide"), "n")


def bbox_rescale(spark, sf_dir):
    boxes = tables.component_boxes(spark, sf_dir)
    page = F.when(F.col("image_id") % 10 == 0, 0).otherwise(300)
    return recognise.rescale(boxes, F.lit(128.0), F.lit(64.0), page, F.lit(200))


def bbox_overlap_join(spark, sf_dir):
    found = match.overlaps(tables.component_boxes(spark, sf_dir), tables.character_boxes(spark, sf_dir))
    return found.where("inside >= 0.3").select("image_id", "char", "label", "overlap")


def bbox_match_fallback(spark, sf_dir):
    return match.matched(tables.component_boxes(spark, sf_dir), tables.character_boxes(spark, sf_dir))


def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four boxes a to d per small raster."""
    boxes = F.array(*[F.struct(F.lit(c).alias("char"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h")) for c, x, y in (("a", 0, 0), ("b", 4, 0), ("c", 0, 4), ("d", 4, 4))])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(boxes).alias("q")).select("image_id", "q.*")


def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = components.label_map(small_ink(spark, sf_dir))
    kept = match.matched(components.component_stats(labels), quadrants(spark, sf_dir))
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return match.crops(labels, kept, sizes, pad=1)


def char_crop(spark, sf_dir):
    return crop_pixels(spark, sf_dir)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, place): letters saved per user, one per event, the later ones first among equals."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 43).cast("int").alias("place"), "event_id", "value")


def saved_glyphs(spark, sf_dir):
    """The last save of each letter wins."""
    return drawn(spark, sf_dir).groupBy("session_id", "place").agg(F.max_by("value", "event_id").alias("value"))


def undrawn_letters(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    every = sessions.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(42)))).join(F.broadcast(L.letters(spark)), "place")
    return every.join(drawn(spark, sf_dir), ["session_id", "place"], "left_anti").select("session_id", "letter")


def draw_progress(spark, sf_dir):
    done = drawn(spark, sf_dir).groupBy("session_id").agg(F.count_distinct("place").alias("n"))
    return done.select("session_id", "n", (F.col("n") / 43.0).alias("share"))


def order_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An SVG document around each order's path; some have sizes, some a view box, some no second path."""
    k = F.col("path_id")
    size = F.when(k % 3 == 0, F.format_string('width="%d.5px" height="%d"', k % 50 + 1, k % 40 + 1)).when(k % 3 == 1, F.format_string('viewBox="0 0 %d %d"', k % 50 + 1, k % 40 + 1)).otherwise("")
    more = F.when(k % 2 == 0, '<path fill="x" d=" M1 1 Z "/><path d="  "/>').otherwise("<path/>")
    scale = F.when(k % 5 == 0, "scale(-0.1)").otherwise("scale(-0.1,0.1)")
    return tables.order_paths(spark, sf_dir).select("path_id", "d", F.concat(F.lit("<svg "), size, F.lit('><g transform="translate(0,9) '), scale, F.lit('"><path d="'), F.col("d"), F.lit('"/>'), more, F.lit("</g></svg>")).alias("svg"))


def svg_extract_paths(spark, sf_dir):
    return order_svg(spark, sf_dir).select("path_id", F.posexplode(svgpath.svg_paths(F.col("svg"))).alias("i", "d"))


def svg_viewbox(spark, sf_dir):
    size = svgpath.svg_size(F.col("svg"))
    return order_svg(spark, sf_dir).select("path_id", size["width"].alias("width"), size["height"].alias("height"))


def svg_scale(spark, sf_dir):
    return order_svg(spark, sf_dir).select("path_id", svgpath.svg_scale(F.col("svg")).alias("scale"), svgpath.traced_height(F.col("svg")).alias("traced_height"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.parsed_paths(tables.order_paths(spark, sf_dir).select("path_id", "d"))


def svg_parse_path(spark, sf_dir):
    return parsed(spark, sf_dir).select("path_id", F.posexplode("commands").alias("i", "c")).select("path_id", "i", "c.*")


def path_bbox(spark, sf_dir):
    return parsed(spark, sf_dir).select("path_id", svgpath.path_box(F.col("commands")).alias("b")).select("path_id", "b.*")


def lettered(spark: SparkSession, sf_dir: str, chars: str = L.LETTERS) -> DataFrame:
    """Order paths as glyphs: 43 consecutive ones make a font."""
    k = F.col("path_id")
    symbols = F.array(*map(F.lit, chars))
    return parsed(spark, sf_dir).select(F.floor(k / len(chars)).alias("font_id"), F.get(symbols, (k % len(chars)).cast("int")).alias("char"), "path_id", "commands")


def _points(df: DataFrame) -> DataFrame:
    return df.select("path_id", "char", "advance", "bearing", F.posexplode("commands").alias("i", "c")).select("path_id", "char", "advance", "bearing", "i", "c.type", "c.x", "c.y")


def font_coords_letter(spark, sf_dir):
    return _points(font.font_coordinates(lettered(spark, sf_dir, "abcdefghijklmnopqrstuvwxyz")))


def font_coords_punctuation(spark, sf_dir):
    return _points(font.font_coordinates(lettered(spark, sf_dir, "".join(L.PUNCTUATION))))


def font_coords_uniform(spark, sf_dir):
    return _points(font.font_coordinates(lettered(spark, sf_dir), F.lit(7560.0)))


def glyph_table(spark, sf_dir):
    return font.glyph_table(lettered(spark, sf_dir)).select("font_id", "name", "code", "advance", F.size("commands").alias("n"))


def font_bytes(spark, sf_dir):
    made = font.made_fonts(lettered(spark, sf_dir))
    return made.select("font_id", "n_glyphs", "chars", F.length("font").alias("n_bytes"), F.sha2("font", 256).alias("sha256"))


def _plain(decisions: DataFrame) -> DataFrame:
    """Times without a zone, as the events have them."""
    return decisions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "reset")})


def rate_limit_batch(spark, sf_dir):
    return _plain(limiter.limited(tables.requests(spark, sf_dir), DAY, TWO))


def rate_limit_stream(spark, sf_dir):
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    requests = events.select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    at = scratch_dir(spark)
    return _plain(limited_stream(requests, f"{at}/decisions", f"{at}/progress", DAY, TWO))


def request_validation(spark, sf_dir):
    """Every branch of the chain, chosen by the request's id; the limiter decides first, as it does for callers."""
    decided = limiter.limited(tables.requests(spark, sf_dir), DAY, TWO)
    k = F.col("id")
    kind = F.when(k % 5 == 0, "text/plain").when(k % 5 == 1, F.lit(None)).otherwise("application/json; charset=utf-8")
    body = (
        F.when(k % 7 == 0, "{broken")
        .when(k % 7 == 1, "{}")
        .when(k % 7 == 2, '{"image":"data:image/png;base64,AAAA"}')
        .when(k % 7 == 3, '{"image":"a b"}')
        .otherwise('{"image":"aGVsbG8="}')
    )
    upstream = F.when(k % 11 == 0, 403).when(k % 11 == 1, 429).when(k % 11 == 2, 500).otherwise(200)
    answer = web.validate_request(k % 13 == 0, ~F.col("allowed"), k % 17 != 0, kind, body, upstream)
    ip = web.client_ip(F.when(k % 3 == 0, F.format_string(" 10.0.0.%d , 1.1.1.1", k % 200)).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.format_string("172.16.0.%d", k % 200)))
    wait = F.when(answer["status"] == 429, limiter.retry_after(F.col("reset"), F.col("ts")))
    return decided.select("id", answer["status"].alias("status"), answer["error"].alias("error"), ip.alias("ip"), wait.alias("retry_after"))


def origin_policy(spark, sf_dir):
    k, origin = F.col("page_id"), web.origin_of(F.col("url"))
    own = F.when(k % 2 == 0, F.col("url")).otherwise("https://api.example.com/vision")
    caller = F.when(k % 7 == 0, "http://localhost:3000").when(k % 7 == 1, "https://app.example.com").otherwise(origin)
    allowed = web.allowed_origin(caller, own, "https://app.example.com", development=True)
    return table(spark, sf_dir, "pages").select("page_id", caller.alias("origin"), allowed.alias("allowed"), F.when(allowed.isNotNull(), 204).otherwise(403).alias("status"))


def base64_roundtrip(spark, sf_dir):
    coded = web.base64_text(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(coded).alias("n"), F.md5(coded).alias("md5"), (F.decode(F.unbase64(coded), "UTF-8") == F.col("text")).alias("same"))


def data_url_parse(spark, sf_dir):
    mime = F.when(F.col("item_id") % 3 == 0, "image/jpeg").when(F.col("item_id") % 3 == 1, "font/sfnt")
    rows = table(spark, sf_dir, "benchmark").select("item_id", web.data_url_parts(web.data_url(mime, F.encode("text", "UTF-8"))).alias("u"))
    return rows.select("item_id", "u.mime", F.decode(F.unbase64("u.payload"), "UTF-8").alias("text"))


def font_format_sniff(spark, sf_dir):
    k = F.col("doc_id")
    data = F.encode(F.when(k % 3 == 0, F.concat(F.lit("wOF2"), "text")).when(k % 3 == 1, F.lit("wOF")).otherwise(F.col("text")), "UTF-8")
    kind = web.font_format(data)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("format"), web.font_mime(kind).alias("mime"), web.font_css(F.lit("Hand"), F.format_string("u%d", k), kind).alias("css"))


def name_sanitise(spark, sf_dir):
    """Names that are blank, that have nothing left, with tabs and line ends around them, that are missing, and plain ones."""
    k = F.col("p_partkey") % 10
    plain = F.concat(F.lit("  "), "p_name", F.lit("  #"), "p_brand", F.lit("! "))
    name = F.when(k == 0, "   ").when(k == 1, "漢字!").when(k == 2, F.concat(F.lit("\t"), "p_name", F.lit("\n"))).when(k > 3, plain)
    return table(spark, sf_dir, "part").select("p_partkey", web.file_name(name).alias("name"))


def date_slug(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", web.date_slug(F.col("o_orderdate")).alias("slug"))


def confidence_buckets(spark, sf_dir):
    c = (F.col("doc_id") % 101) / 100.0
    return table(spark, sf_dir, "labels").select("doc_id", web.confidence_bucket(c).alias("bucket"), F.floor(c * 100 + 0.5).alias("percent"))


def label_palette(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", web.palette(F.col("vec_id").cast("double")).alias("c")).select("vec_id", "c.*")


def pointer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), "event_type", k.alias("x"), F.floor("value").cast("double").alias("y"), F.when(F.col("event_id") % 4 != 0, k / 100).alias("pressure"))


def stroke_sessions(spark, sf_dir):
    rows = strokes.stroked(pointer_events(spark, sf_dir), F.col("event_type") == "signup", F.col("event_type") == "error")
    return rows.groupBy("user", "stroke_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.floor(F.sum("pressure") * 100 + 0.5).alias("pressure"))


def stroke_stream_batches(spark, sf_dir):
    """The pointer's strokes as a stream, read back: those that ended by an event."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("double")
    events = e.select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), "ts", "event_type", k.alias("x"), F.floor("value").cast("double").alias("y"), F.when(F.col("event_id") % 4 != 0, k / 100).alias("pressure"))
    at = scratch_dir(spark)
    found = stroke_stream(events, F.col("event_type") == "signup", F.col("event_type") == "error", f"{at}/strokes", f"{at}/progress", rest=10**15)
    points = F.col("points")
    whole = lambda c: F.floor(F.aggregate(F.transform(points, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) * 100 + 0.5).alias(c)
    return found.select("user", "stroke_id", F.size(points).cast("long").alias("n"), points[0]["seq"].alias("first"), F.element_at(points, -1)["seq"].alias("last"), whole("pressure"))


def stroke_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, stroke_id, points): the pointer's places and pressures of each stroke, in order."""
    rows = strokes.stroked(pointer_events(spark, sf_dir), F.col("event_type") == "signup", F.col("event_type") == "error")
    return rows.groupBy("user", "stroke_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "pressure"))).alias("points"))


#: Thickness of the brush.
BRUSH = 8.0


def stroke_outline(spark, sf_dir):
    """Points of each stroke's outline, in thousandths; strokes of a single point have none."""
    rows = strokes.outlined(stroke_points(spark, sf_dir), BRUSH)
    whole = lambda c: F.floor(F.col(f"p.{c}") * 1000 + 0.5).alias(c)
    return rows.select("user", "stroke_id", F.posexplode("outline").alias("i", "p")).select("user", "stroke_id", "i", whole("x"), whole("y"))


def stroke_svg_path(spark, sf_dir):
    return strokes.outlined(stroke_points(spark, sf_dir), BRUSH).select("user", "stroke_id", svgpath.stroke_path(F.col("outline")).alias("d"))


#: The canvas of the painted strokes: 20 by 12 pixels, brush and pointer scaled to it.
CANVAS = (20, 12)


def stroke_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, letter, turn, seq, points): strokes on a small canvas, seven letters a user, flattened to lines."""
    small = F.transform("points", lambda p: F.struct((p["x"] * 0.2).alias("x"), (p["y"] / 50 + 1).alias("y"), p["pressure"].alias("pressure")))
    rows = stroke_points(spark, sf_dir).select("user", "stroke_id", F.col("points")[0]["seq"].alias("seq"), small.alias("points"))
    shapes = strokes.outlined(rows, 2.0).where("outline is not null")
    letter = F.get(F.array(*map(F.lit, "abcdefg")), (F.col("stroke_id") % 7).cast("int"))
    return shapes.select(F.col("user").alias("session_id"), letter.alias("letter"), F.col("stroke_id").alias("turn"), "seq", F.inline(F.array(F.struct(stroke_outlines.flattened(F.col("outline")).alias("points")))))


def stroke_raster(spark, sf_dir):
    """The canvases of all letters: strokes of half opacity over white, darker where they cross."""
    px = paint.painted(stroke_chains(spark, sf_dir), ["session_id", "letter"], *CANVAS, opacity=0.5)
    return px.where("g < 255")


def saved_letters(spark, sf_dir):
    """Each stroke is a canvas that is saved as a picture; the last picture of a letter stays. Its ink, read back from the file."""
    last = paint.kept(paint.pictures(stroke_chains(spark, sf_dir), ["session_id", "letter", "seq"], *CANVAS))
    ink = debugviz.png_pixels(last, ["session_id", "letter"])
    return ink.groupBy("session_id", "letter").agg(F.count("*").alias("n"), F.sum((255 - F.col("r")).cast("long")).alias("ink"), F.sum((F.col("g") * (F.col("x") + 100 * F.col("y"))).cast("long")).alias("mark"))


def session_json_roundtrip(spark, sf_dir):
    """Sessions written as JSON, some of them broken or without a font, and read back."""
    k = F.col("event_id")
    saved = F.to_json(F.struct(F.when(k % 5 != 0, F.format_string("Rk9OVA%d", k)).alias("fontBase64"), F.when(k % 7 != 0, F.array(F.lit("a"), F.col("event_type"))).alias("charsFound"), F.lit("draw").alias("mode")))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 11 == 0, F.concat(F.lit("{"), saved)).otherwise(saved).alias("json"))
    read = images.read_sessions(rows)
    return read.select("event_id", "intact", F.when(F.col("intact"), F.col("saved.fontBase64")).alias("font"), F.when(F.col("intact"), F.array_join("saved.charsFound", ",")).alias("chars"))


def random_pick_seeded(spark, sf_dir, seed: int = 7):
    """One undrawn letter per session, by a seeded hash."""
    draw = W.partitionBy("session_id").orderBy(F.md5(F.concat_ws(":", F.col("session_id").cast("string"), "letter", F.lit(str(seed)))), "letter")
    return undrawn_letters(spark, sf_dir).withColumn("turn", F.row_number().over(draw)).where("turn = 1").select("session_id", "letter")


def trace_edges(spark, sf_dir):
    return trace.boundary_edges(small_ink(spark, sf_dir))


def trace_outlines(spark, sf_dir):
    """Traced paths and the area they enclose, which is the ink's."""
    traced = trace.traced(small_ink(spark, sf_dir)).select("image_id", F.explode("paths").alias("d")).withColumn("c", svgpath.parse_path(F.col("d")))
    points = F.filter("c", lambda p: p["type"] != "Z")
    turn = F.zip_with(points, F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area = F.aggregate(turn, F.lit(0.0), lambda s, v: s + v) / 2
    return traced.groupBy("image_id").agg(F.sum(area).cast("long").alias("area"))


def trace_curves(spark, sf_dir):
    """Curved outlines: the ink and its edges, and whether the curves enclose as much ink, to a quarter of a pixel for every edge."""
    ink = small_ink(spark, sf_dir)
    traced = trace.traced(ink, curves=True, despeckle=0).select("image_id", F.explode("paths").alias("d")).select("image_id", svgpath.path_area(svgpath.parse_path(F.col("d"))).alias("area"))
    edges = trace.boundary_edges(ink).groupBy("image_id").agg(F.count("*").alias("edges"))
    counts = ink.where("ink = 255").groupBy("image_id").agg(F.count("*").alias("ink")).join(edges, "image_id")
    rows = counts.join(traced.groupBy("image_id").agg(F.sum("area").alias("area")), "image_id")
    return rows.select("image_id", "ink", "edges", (F.abs(F.col("area") - F.col("ink")) <= 0.25 * F.col("edges")).alias("close"))


def drawn_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as drawn letters, 43 a font; single pixels are letters here."""
    k = F.col("vec_id")
    char = F.get(F.array(*map(F.lit, L.LETTERS)), (k % 43).cast("int"))
    places = table(spark, sf_dir, "embeddings").select(k.alias("image_id"), F.floor(k / 43).alias("font_id"), char.alias("char"), k.alias("entry"))
    return drawing.drawn_fonts(tables.small_rasters(spark, sf_dir), places, despeckle=0)


def drawn_glyph_fonts(spark, sf_dir):
    return drawn_fonts(spark, sf_dir).select("font_id", "status", "n_glyphs", "chars", F.length("font").alias("n_bytes"), F.sha2("font", 256).alias("sha256"))


#: Fonts whose files are read at a time, so that a task's memory follows them and not Arrow's rows.
AT_ONCE = 64


def decoded(made: DataFrame) -> DataFrame:
    """(font_id, code, glyph, advance) of every character, read from the bytes of the fonts; ``glyph`` is its place in the file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                flat = []
                for i, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    f = font.read_font(data)
                    flat += [(i, code, glyph, f["advances"][glyph]) for code, glyph in f["codes"].items()]
                columns = zip(*flat) if flat else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["font_id", "code", "glyph", "advance"])

    return made.where("font is not null").select("font_id", "font").mapInArrow(run, "font_id long, code long, glyph long, advance long")


def font_readback(spark, sf_dir):
    """The code maps, glyph order and advances of the fonts of ``font_bytes``, as their files tell them."""
    return decoded(font.made_fonts(lettered(spark, sf_dir)))


def outline_points(made: DataFrame) -> DataFrame:
    """(font_id, code, i, type, x, y): the commands of every character's charstring, read from the bytes of the fonts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"font_id": pa.int64(), "code": pa.int64(), "i": pa.int32(), "type": pa.string(), "x": pa.int64(), "y": pa.int64()}
        names = pa.array(list(font.DRAWS.values()))
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                drawings, starts, ids, codes, glyphs, size, n = [], [], [], [], [], 0, 0
                for i, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    read = font.read_font(data)
                    cff = read["tables"]["CFF "]
                    base, offsets = font.drawings_of(cff)
                    drawings.append(cff[base + int(offsets[0]) : base + int(offsets[-1])])
                    starts.append(offsets[:-1] - offsets[0] + size)
                    ids += [i] * len(read["codes"])
                    codes += read["codes"]
                    glyphs += [n + g for g in read["codes"].values()]
                    size += len(drawings[-1])
                    n += len(offsets) - 1
                found = font.outlines(b"".join(drawings), np.concatenate(starts))
                glyph = np.array(glyphs, np.int64)
                sizes = found.sizes[glyph]
                k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = k + np.repeat((np.cumsum(found.sizes) - found.sizes)[glyph], sizes)
                operator = np.select([found.operator[at] == o for o in font.DRAWS], range(len(font.DRAWS)))
                columns = [np.repeat(ids, sizes), np.repeat(codes, sizes), k.astype(np.int32), names.take(pa.array(operator)), found.x[at], found.y[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))

    return made.where("font is not null").select("font_id", "font").mapInArrow(run, "font_id long, code long, i int, type string, x long, y long")


def font_outlines(spark, sf_dir):
    """The points that the glyphs' charstrings end their commands in, as the files of ``font_bytes`` tell them."""
    return outline_points(font.made_fonts(lettered(spark, sf_dir)))


def drawn_font_codes(spark, sf_dir):
    """The codes that the drawn fonts' files have, without advances, which follow the outlines."""
    return decoded(drawn_fonts(spark, sf_dir)).select("font_id", "code")


def font_status(spark, sf_dir):
    """Every tenth font has no commands: it is named, with the reason."""
    glyphs = lettered(spark, sf_dir)
    # From the orders' numbers, so that no path is parsed for it.
    asked = tables.order_paths(spark, sf_dir).select(F.floor(F.col("path_id") / len(L.LETTERS)).alias("font_id")).distinct()
    some = glyphs.withColumn("commands", F.when(F.col("font_id") % 10 != 0, F.col("commands")).otherwise(F.slice("commands", 1, 0)))
    made = drawing.with_status(font.made_fonts(some), asked, F.lit(drawing.NO_GLYPHS))
    return made.select("font_id", "status", "n_glyphs", "chars")


def font_names(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, web.font_name(F.when(k % 4 != 0, F.col("c_name")), k, 3).alias("name"))


def pangram_shuffle(spark, sf_dir):
    """A pangram for each session, and another one drawn after it: any but the current one."""
    n = len(L.PANGRAMS)
    k = F.col("user_id")
    first = web.seeded(k, 1, n)
    after = web.seeded(k, 2, n - 1)
    return table(spark, sf_dir, "events").select(k).distinct().select(k, first.alias("pangram"), F.when(after >= first, after + 1).otherwise(after).alias("next"))


def raster_rgba(spark, sf_dir):
    return raster.rgba(small_ink(spark, sf_dir))


def response_headers(spark, sf_dir):
    k, origin = F.col("page_id"), web.origin_of(F.col("url"))
    allowed = web.allowed_origin(F.when(k % 3 != 0, origin), F.col("url"))
    headers = web.with_cors(F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("Access-Control-Max-Age"), F.lit("1")), allowed)
    return table(spark, sf_dir, "pages").select(k, F.explode(headers).alias("header", "value"))


def stroke_replay(spark, sf_dir):
    drawn_ = stroke_svg_path(spark, sf_dir).select("user", "stroke_id", F.col("d").alias("path"), F.lit("#1a1a1a").alias("fill"))
    return strokes.replay(drawn_).select("user", "turn", "stroke_id", "fill", F.md5("path").alias("md5"))


def file_sink(spark, sf_dir):
    """Texts written as files of their own, in a folder by kind, and read back."""
    at = scratch_dir(spark)
    k = F.col("item_id")
    name = F.format_string("kind-%d/%d.txt", k % 3, k)
    written = files.write_files(table(spark, sf_dir, "benchmark"), at, name, F.encode("text", "UTF-8"))
    return files.read_files(spark, at, written).select("name", F.length("content").alias("n_bytes"), F.md5("content").alias("md5"))


def debug_files(spark, sf_dir):
    """The debug pictures as files, a folder per stage, and what their pixels add up to, read back from the files."""
    at = scratch_dir(spark)
    written = files.write_files(stage_pictures(spark, sf_dir), at, F.format_string("%s/%d.png", "stage", "image_id"), F.col("png"))
    read = files.read_files(spark, at, written).where(images.image_type(F.col("content")) == "image/png")
    named = read.select(F.split("name", "/")[0].alias("stage"), F.regexp_extract("name", r"/(\d+)\.png$", 1).cast("long").alias("image_id"), F.col("content").alias("png"))
    px = debugviz.png_pixels(named, ["stage", "image_id"])
    dark = F.when(F.col("stage") != "labels", (F.col("r") == 0) & (F.col("g") == 0)).otherwise((F.col("r") != 30) | (F.col("g") != 30) | (F.col("b") != 30))
    place = F.col("y") * 8 + F.col("x")
    return px.groupBy("stage", "image_id").agg(F.count(F.when(dark, 1)).alias("inked"), F.coalesce(F.sum(F.when(dark, place)), F.lit(0)).cast("long").alias("places"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves and clears: errors clear all, signups clear the drawing, others save one slot."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    slot = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "signup", "draw").otherwise(F.element_at(F.array(*map(F.lit, sessions.SLOTS)), (k % 3 + 1).cast("int")))
    text = (
        F.when(F.col("event_type").isin("error", "signup"), F.lit(None))
        .when(k % 3 == 1, F.when(k % 2 == 0, F.format_string('{"text":"t%d","fontSize":%d,"noteColorId":"yellow"}', k, k % 40)).otherwise("{broken"))
        .when(k % 3 == 2, F.when(k % 4 == 0, "{}").otherwise(F.format_string('{"a":"data:image/png;base64,AA%d"}', k)))
        .otherwise(F.format_string('{"fontBase64":"Rk9O%d"}', k))
    )
    return e.select(F.col("user_id").alias("session_id"), slot.alias("slot"), k.alias("seq"), text.alias("json"))


def session_store(spark, sf_dir):
    """Sessions saved over each other and cleared by two logs, one after the other; broken entries dropped; and restored."""
    at = scratch_dir(spark)
    log = session_log(spark, sf_dir)
    half = F.col("seq") % 2 == 0
    sessions.save(log.where(half), at)
    sessions.save(log.where(~half), at)
    sessions.drop_corrupt(spark, at)
    rows, slot = sessions.load(spark, at), F.col("slot")
    page, drawn_ = sessions.playground(F.col("json")), sessions.draw_progress(F.col("json"))
    letter = F.when(slot == "draw", web.data_url_parts(drawn_["a"])["payload"])
    return rows.select("session_id", "slot", F.when(slot == "playground", page["text"]).alias("text"), F.when(slot == "playground", page["fontSize"]).alias("size"), letter.alias("letter"))


def letter_navigation(spark, sf_dir):
    """Events as steps through the letters; one in seven finds a blank canvas."""
    k = F.col("event_id")
    action = F.when(F.col("event_type") == "click", "go").when(F.col("event_type") == "error", "skip").when((F.col("event_type") == "signup") & (k % 31 == 0), "finish").otherwise("next")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), k.alias("seq"), action.alias("action"), (k * 7 % 43).cast("int").alias("to"), (k % 7 != 0).alias("inked"))
    return navigation.navigated(steps)


def pangram_fonts(spark, sf_dir):
    """The sheets as photos, benchmark texts as what was recognised in them."""
    made = pangram.pangram_fonts(tables.sheets(spark, sf_dir), tables.recognition_json(spark, sf_dir), least_area=2)
    return made.select("font_id", "status", "n_glyphs", "chars", F.length("font").alias("n_bytes"), F.sha2("font", 256).alias("sha256"))


def reference_height(spark, sf_dir):
    rows = drawn(spark, sf_dir).join(F.broadcast(L.letters(spark)), "place")
    height = F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("double")).otherwise(0.0)
    return drawing.reference_heights(rows.select(F.col("session_id").alias("font_id"), F.col("letter").alias("char"), F.col("event_id").alias("entry"), height.alias("height")))


def note_colour(spark, sf_dir):
    """A colour's value by its name, the first one for names that are not among them."""
    notes = spark.createDataFrame([("view", "#fff9c4"), ("click", "#ffe0b2"), ("error", "#ffcdd2")], "event_type string, found string")
    rows = table(spark, sf_dir, "events").join(F.broadcast(notes), "event_type", "left")
    return rows.select("event_id", F.coalesce("found", F.lit("#fff9c4")).alias("colour"))


def stage_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, image_id, png): the four pictures of each small raster: ink, boxes, labels, crops."""
    ink = small_ink(spark, sf_dir)
    labels = components.label_map(ink)
    shown = {"ink": debugviz.raster_png(ink), "boxes": debugviz.boxes_png(ink, quadrants(spark, sf_dir)), "labels": debugviz.labels_png(labels), "crops": debugviz.crops_png(crop_pixels(spark, sf_dir))}
    out = None
    for stage, picture in shown.items():
        rows = picture.select(F.lit(stage).alias("stage"), "image_id", "png")
        out = rows if out is None else out.unionByName(rows)
    return out


def debug_pictures(spark, sf_dir):
    return stage_pictures(spark, sf_dir).select("stage", "image_id", F.length("png").alias("n_bytes"), F.sha2("png", 256).alias("sha256"))


def queries() -> dict[str, Query]:
    every = (
        gray_luma, raster_invert, raster_blur5x5, adaptive_threshold, histogram256, otsu_threshold, dilate_3x3, erode_3x3, close_3x3, close_2x2_identity,
        component_stats, component_label_map, remove_small_components, component_neighbours, ink_bounds, single_glyph_center, photo_preprocess, glyph_preprocess,
        recognized_first_letters, unique_chars, pangram_coverage, letter_categories, bbox_rescale, bbox_overlap_join, bbox_match_fallback, char_crop,
        saved_glyphs, undrawn_letters, draw_progress, svg_extract_paths, svg_viewbox, svg_scale, svg_parse_path, path_bbox,
        font_coords_letter, font_coords_punctuation, font_coords_uniform, glyph_table, font_bytes, rate_limit_batch, rate_limit_stream, request_validation, origin_policy,
        base64_roundtrip, data_url_parse, font_format_sniff, name_sanitise, date_slug, confidence_buckets, label_palette, stroke_sessions, stroke_stream_batches, stroke_outline, stroke_svg_path, stroke_raster, saved_letters,
        session_json_roundtrip, random_pick_seeded, trace_edges, trace_outlines, trace_curves, drawn_glyph_fonts, pangram_fonts, reference_height, note_colour, debug_pictures,
        font_readback, font_outlines, drawn_font_codes, font_status, font_names, pangram_shuffle, raster_rgba, response_headers, stroke_replay, file_sink, debug_files, session_store,
        recognition_status, label_counts, font_registry, letter_navigation,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in queries()}
