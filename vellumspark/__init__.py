"""A PySpark-native raster and glyph analytics engine."""

__version__ = "0.1.0"
