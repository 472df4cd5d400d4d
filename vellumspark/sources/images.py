"""Real images and recogniser responses as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Images are scaled down until no side is longer than this.
LONGEST_SIDE = 1200

RESPONSE = (
    "responses ARRAY<STRUCT<fullTextAnnotation: STRUCT<text: STRING, pages: ARRAY<STRUCT<width: INT, height: INT, blocks: ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<"
    "words: ARRAY<STRUCT<symbols: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, boundingBox: STRUCT<vertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>>>>>>>>>>>>"
)


def resampling(size: int, to: int):
    """The (to, size) weights of a side scaled down: each new pixel is the mean of what it covers, parts of pixels counted by their share."""
    import numpy as np

    edges = np.arange(to + 1) * size / to
    cover = np.minimum(edges[1:, None], np.arange(1, size + 1)) - np.maximum(edges[:-1, None], np.arange(size))
    return np.maximum(cover, 0) * to / size


def resampled(px, width: int, height: int):
    """Pixels (h, w, channels) scaled down to ``width`` by ``height``, first along columns, then along rows; levels rounded half up."""
    import numpy as np

    h, w, n = px.shape
    rows = np.einsum("th,hwc->twc", resampling(h, height), px.astype(float)) if height < h else px.astype(float)
    both = np.einsum("tw,hwc->htc", resampling(w, width), rows) if width < w else rows
    return np.clip(np.floor(both + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, rgb): decoded images, packed three bytes a pixel in red, green, blue order,
    scaled to at most ``LONGEST_SIDE`` by the mean of what a new pixel covers."""
    side = LONGEST_SIDE

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                w, h, n = r["width"], r["height"], r["nChannels"]
                px = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
                px = np.repeat(px, 3, axis=2) if n == 1 else px[:, :, 2::-1]
                scale = min(1.0, side / max(w, h))
                tw, th = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
                if scale < 1:
                    px = resampled(px, tw, th)
                rows.append({"origin": r["origin"], "width": tw, "height": th, "rgb": np.ascontiguousarray(px).tobytes()})
            schema = pa.schema([("origin", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return images.mapInArrow(pack, "origin string, width int, height int, rgb binary")


def image_pixels(images: DataFrame) -> DataFrame:
    """(origin, x, y, r, g, b): packed pixels (origin, width, rgb) as rows, in the JVM."""
    at = F.posexplode(F.split(F.hex("rgb"), "(?<=\\G.{6})"))
    rows = images.select("origin", "width", at.alias("i", "hex")).where("hex <> ''")
    level = lambda k: F.conv(F.substring("hex", 2 * k + 1, 2), 16, 10).cast("int")
    place = [(F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y")]
    return rows.select("origin", *place, *(level(k).alias(c) for k, c in enumerate("rgb")))


#: The first bytes of the image types that an upload may have, in hexadecimal.
SIGNATURES = {"image/png": "89504E47", "image/jpeg": "FFD8FF", "image/gif": "47494638", "image/webp": "52494646"}


def image_type(content: Column) -> Column:
    """The MIME type by the first bytes; null for what is no image."""
    head = F.hex(F.substring(content, 1, 4))
    return F.coalesce(*(F.when(head.startswith(start), mime) for mime, start in SIGNATURES.items()))


def uploads(files: DataFrame) -> DataFrame:
    """Of files (content, ...) those that are images, with their ``mime``."""
    return files.withColumn("mime", image_type(F.col("content"))).where("mime is not null")


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """New image files of a folder as they arrive: (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)


def parse_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """``df`` with the JSON of ``column`` as a tree in ``parsed``; broken JSON gives null."""
    return df.withColumn("parsed", F.from_json(column, RESPONSE))


def read_sessions(df: DataFrame, column: str = "json") -> DataFrame:
    """Saved sessions: (all columns, saved, intact); broken JSON and a lack of font or characters count as not intact."""
    schema = "fontBase64 STRING, charsFound ARRAY<STRING>, familyName STRING, mode STRING, _broken STRING"
    saved = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    df = df.withColumn("saved", saved)
    intact = F.col("saved._broken").isNull() & (F.coalesce(F.col("saved.fontBase64"), F.lit("")) != "") & F.col("saved.charsFound").isNotNull()
    return df.withColumn("intact", F.coalesce(intact, F.lit(False)))
