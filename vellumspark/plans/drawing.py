"""Drawn glyphs to a font: Otsu ink, outlines of the whole canvas, one scale for all letters, file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators import font, trace
from vellumspark.plans.photo import glyph_ink

OK, NO_GLYPHS, NO_LETTERS = "ok", "no valid glyphs", "no characters recognised"


def reference_heights(glyphs: DataFrame) -> DataFrame:
    """(font_id, reference): the first height above 0 in the order of entries, digits before the other characters.

    ``glyphs`` has font_id, char, entry and height.
    """
    order = F.struct(F.when(F.col("char").rlike("^[0-9]$"), F.col("char")).otherwise("~").alias("digit"), F.col("entry").alias("entry"))
    return glyphs.groupBy("font_id").agg(F.min_by("height", F.when(F.col("height") > 0, order)).alias("reference"))


def drawn_glyphs(px: DataFrame, places: DataFrame, despeckle: int = 2) -> DataFrame:
    """(font_id, char, entry, paths, height) of drawn rasters ``px`` (image_id, x, y, g); those without ink have no row.

    Outlines are curves; those that enclose at most ``despeckle`` pixels are dropped. ``places`` (image_id, font_id, char, entry) tells whose letter each raster is; a raster's height is that of its canvas.
    """
    heights = px.groupBy("image_id").agg((F.max("y") + 1).cast("double").alias("height"))
    traced = trace.traced(glyph_ink(px), curves=True, despeckle=despeckle).where(F.size("paths") > 0)
    own = places.select("image_id", "font_id", F.lower("char").alias("char"), "entry")
    return traced.select("image_id", "paths").join(own, "image_id").join(heights, "image_id").drop("image_id")


def drawn_fonts(px: DataFrame, places: DataFrame, family: str = "MyHandwriting", strict: bool = False, despeckle: int = 2) -> DataFrame:
    """(font_id, font, n_glyphs, chars, status) for each font of ``places``; the scale follows the first height above 0."""
    glyphs = drawn_glyphs(px, places, despeckle)
    made = font.glyph_commands(glyphs).drop("paths").join(reference_heights(glyphs), "font_id")
    fonts = font.made_fonts(made.select("font_id", "char", "commands", "reference"), F.col("reference"), family)
    return with_status(fonts, places.select("font_id").distinct(), F.lit(NO_GLYPHS), strict)


def with_status(made: DataFrame, asked: DataFrame, failed: Column, strict: bool = False) -> DataFrame:
    """A row for each font of ``asked``: ``status`` is ok or ``failed``, why there is no font. ``strict`` raises an error instead."""
    rows = asked.join(made, "font_id", "left").withColumn("status", F.when(F.col("font").isNotNull(), OK).otherwise(failed))
    if strict:
        rows = rows.withColumn("status", F.when(F.col("status") == OK, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("font "), F.col("font_id").cast("string"), F.lit(": "), F.col("status")))))
    return rows
