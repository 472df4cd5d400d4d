"""Recogniser responses flattened to first letters with boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.sources.images import parse_responses


def polygon_box(vertices: Column) -> Column:
    """Bounding box of a polygon; a missing coordinate is 0, no vertices give a null box."""
    side = lambda k: F.transform(vertices, lambda v: F.coalesce(v[k], F.lit(0.0)))
    xs, ys = side("x"), side("y")
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h")
    )


def response_status(responses: DataFrame) -> DataFrame:
    """(image_id, status) of each response: ok, or why nothing can be read from it."""
    parsed = parse_responses(responses)
    note = F.get("parsed.responses", F.lit(0))["fullTextAnnotation"]
    status = F.when(F.col("parsed").isNull() | F.col("parsed.responses").isNull(), "broken").when(note.isNull(), "no annotation").when(F.coalesce(F.size(note["pages"]), F.lit(0)) < 1, "no pages").otherwise("ok")
    return parsed.select("image_id", status.alias("status"))


def symbols(responses: DataFrame) -> DataFrame:
    """(image_id, page_width, page_height, place, text, confidence, box) in the order of reading."""
    top = F.get("parsed.responses", F.lit(0))["fullTextAnnotation"]
    df = parse_responses(responses).select("image_id", top["pages"].alias("pages"))
    df = df.select("image_id", F.get("pages", F.lit(0))["width"].alias("page_width"), F.get("pages", F.lit(0))["height"].alias("page_height"), F.posexplode("pages").alias("p", "page"))
    keep = ["image_id", "page_width", "page_height", "p"]
    for place, name, inner in (("b", "block", "page.blocks"), ("g", "paragraph", "block.paragraphs"), ("w", "word", "paragraph.words"), ("s", "symbol", "word.symbols")):
        df = df.select(*keep, F.posexplode(inner).alias(place, name))
        keep.append(place)
    s = F.col("symbol")
    confidence = F.coalesce(s["confidence"], F.lit(0.0))
    return df.select("image_id", "page_width", "page_height", F.struct("p", "b", "g", "w", "s").alias("place"), s["text"].alias("text"), confidence.alias("confidence"), polygon_box(s["boundingBox"]["vertices"]).alias("box"))


def letters(responses: DataFrame, least_side: float = 3) -> DataFrame:
    """(image_id, char, x, y, w, h, confidence): the first a to z of each kind whose box is not tiny.

    Tiny boxes go before the first occurrence is chosen, so they use up no letter.
    """
    found = symbols(responses).withColumn("char", F.lower("text")).where(F.col("char").rlike("^[a-z]$"))
    found = found.where((F.col("box.w") >= least_side) & (F.col("box.h") >= least_side))
    first = found.groupBy("image_id", "char").agg(F.min_by(F.struct("box", "confidence"), "place").alias("first"))
    return first.select("image_id", "char", *(F.col(f"first.box.{k}").alias(k) for k in "xywh"), F.col("first.confidence").alias("confidence"))


def rescale(boxes: DataFrame, width, height, page_width, page_height) -> DataFrame:
    """Boxes from page coordinates to an image of ``width`` by ``height``; a page without size scales by 1."""
    sx = F.when(page_width > 0, width / page_width).otherwise(F.lit(1.0))
    sy = F.when(page_height > 0, height / page_height).otherwise(F.lit(1.0))
    at = lambda k, scale: F.floor(F.col(k) * scale + 0.5).cast("int")
    return boxes.withColumns({"x": at("x", sx), "y": at("y", sy), "w": F.greatest(F.lit(1), at("w", sx)), "h": F.greatest(F.lit(1), at("h", sy))})
