"""Static tables of letters, pangrams and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
PANGRAMS = (
    "The quick brown fox jumps over the lazy dog",
    "Pack my box with five dozen liquor jugs",
    "How vexingly quick daft zebras jump",
    "The five boxing wizards jump quickly",
    "Jackdaws love my big sphinx of quartz",
    "Crazy Frederick bought many very exquisite opal jewels",
    "We promptly judged antique ivory buckles for the next prize",
    "A quick movement of the enemy will jeopardize six gunboats",
)
# Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789@,.-’!?"
# Fixed values.
CATEGORIES = {"x-height": "acemnorsuvwxz", "ascender": "bdfhklit", "descender": "gjpqy", "number": "0123456789", "punctuation": "@,.-’!?"}
# Fixed values. Guide lines as shares of the canvas height from the top.
GUIDES = {"ascender": 0.05, "xHeight": 0.31, "baseline": 0.75, "descender": 0.92}
# Fixed values.
EM, ASCENDER, DESCENDER = 1000, 800, -200
TARGET_HEIGHT = ASCENDER - DESCENDER
# Fixed values. Punctuation: share of the target height, and rise above the descender.
PUNCTUATION = {".": (0.12, 0), ",": (0.2, -80), "-": (0.1, 250), "’": (0.18, 520)}


def letters(spark: SparkSession) -> DataFrame:
    """(place, letter, category) of the 43 symbols to draw."""
    category = {c: name for name, chars in CATEGORIES.items() for c in chars}
    return spark.createDataFrame([(i, c, category[c]) for i, c in enumerate(LETTERS)], "place int, letter string, category string")


def pangrams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PANGRAMS)), "pangram_id int, text string")


def punctuation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *m) for c, m in PUNCTUATION.items()], "char string, scale double, y_offset int")
