"""Composed plans: a photo's or a drawn glyph's way from gray pixels to ink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellumspark.operators import components, raster


def photo_ink(px: DataFrame, block: int = 21, c: float = 12, least_area: int = 50) -> DataFrame:
    """Blur, adaptive threshold, and components below ``least_area`` removed: (image_id, x, y, ink)."""
    return components.remove_small(raster.adaptive_threshold(raster.blur(px), block=block, c=c), least_area)


def glyph_ink(px: DataFrame) -> DataFrame:
    """Otsu's threshold and the customary 2 by 2 close, which by its radius changes nothing: (image_id, x, y, ink)."""
    return raster.close(raster.otsu_ink(px), width=2, height=2)
