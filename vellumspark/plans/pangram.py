"""A pangram photo's way to a font: ink, components, recognised letters, crops, outlines, glyphs, file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.operators import components, font, match, recognise, trace
from vellumspark.plans import drawing
from vellumspark.plans.photo import photo_ink


def pangram_crops(px: DataFrame, responses: DataFrame, least_area: int = 50) -> DataFrame:
    """(image_id, char, width, height, x, y): ink of each recognised letter of each photo."""
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    pages = recognise.symbols(responses).groupBy("image_id").agg(F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"))
    boxes = recognise.letters(responses).join(pages, "image_id").join(sizes, "image_id")
    boxes = recognise.rescale(boxes, F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height")).select("image_id", "char", "x", "y", "w", "h")
    labels = components.label_map(photo_ink(px, least_area=least_area))
    return match.crops(labels, match.matched(components.component_stats(labels), boxes), sizes)


def pangram_fonts(px: DataFrame, responses: DataFrame, family: str = "MyHandwriting", least_area: int = 50, strict: bool = False) -> DataFrame:
    """(font_id, font, n_glyphs, chars, status) for each photo; one without recognised characters or valid glyphs has a status that says so."""
    crops = pangram_crops(px, responses, least_area)
    # A crop is a raster of its own: its number in the photo joins the photo's.
    own = F.col("image_id") * 26 + F.ascii("char") - F.ascii(F.lit("a"))
    traced = trace.traced(crops.select(own.alias("image_id"), "x", "y", F.lit(255).alias("ink")), curves=True)
    glyphs = traced.select(F.floor(F.col("image_id") / 26).alias("font_id"), F.char(F.col("image_id") % 26 + F.ascii(F.lit("a"))).alias("char"), "paths")
    made = font.made_fonts(font.glyph_commands(glyphs).drop("paths"), family=family)
    lettered = recognise.letters(responses).select(F.col("image_id").alias("font_id"), F.lit(True).alias("lettered")).distinct()
    asked = px.select(F.col("image_id").cast("long").alias("font_id")).distinct().join(lettered, "font_id", "left")
    failed = F.when(F.col("lettered"), F.lit(drawing.NO_GLYPHS)).otherwise(drawing.NO_LETTERS)
    return drawing.with_status(made, asked, failed, strict).drop("lettered")
