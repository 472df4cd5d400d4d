"""Carriers: the supplied tables read as rasters, symbol trees, boxes, paths and request streams.

The tables hold no images, so each carrier derives its rows from a table by arithmetic that any
SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, g): components scaled to 0..255 between their vector's least and greatest."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.select("vec_id", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"), F.posexplode("e").alias("i", "v"))
    return v.select("vec_id", "i", F.floor(255.0 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5).cast("int").alias("g"))


def small_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, one 8 by 8 raster per vector: (image_id, x, y, g)."""
    return _levels(spark, sf_dir).select(F.col("vec_id").alias("image_id"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "g")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, 64 vectors make the rows of one sheet of width 64: (image_id, x, y, g)."""
    rows = _levels(spark, sf_dir)
    return rows.select(F.floor(F.col("vec_id") / 64).alias("image_id"), F.col("i").alias("x"), (F.col("vec_id") % 64).cast("int").alias("y"), "g")


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, three consecutive vectors are the channels of an 8 by 8 raster: (image_id, x, y, r, g, b); channels that the last one lacks are 0."""
    rows = _levels(spark, sf_dir).withColumn("image_id", F.floor(F.col("vec_id") / 3))
    channel = lambda k: F.coalesce(F.max(F.when(F.col("vec_id") % 3 == k, F.col("g"))), F.lit(0))
    whole = rows.groupBy("image_id", "i").agg(channel(0).alias("r"), channel(1).alias("gr"), channel(2).alias("b"))
    return whole.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "r", F.col("gr").alias("g"), "b")


def recognition_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, benchmark texts as recognition responses: lines are blocks, words words, characters symbols with
    boxes made from their ordinals; a coordinate of 0 is left out, as the recogniser does. (image_id, response)"""

    def symbol(c, li, wi, ci):
        x, y = wi * 12 + ci * 5, li * 20
        w = 2 + (li + wi + ci) % 4
        at = lambda px, py: F.struct(F.when(px != 0, px).alias("x"), F.when(py != 0, py).alias("y"))
        box = F.array(at(x, y), at(x + w, y), at(x + w, y + 9), at(x, y + 9))
        return F.struct(c.alias("text"), (((li * 31 + wi * 17 + ci * 7) % 100) / 100.0).alias("confidence"), F.struct(box.alias("vertices")).alias("boundingBox"))

    def word(w, li, wi):
        return F.struct(F.transform(F.split(w, ""), lambda c, ci: symbol(c, li, wi, ci)).alias("symbols"))

    def block(line, li):
        return F.struct(F.array(F.struct(F.transform(F.split(line, " "), lambda w, wi: word(w, li, wi)).alias("words"))).alias("paragraphs"))

    page = F.struct(F.lit(1000).alias("width"), F.lit(500).alias("height"), F.transform(F.split("text", "\n"), block).alias("blocks"))
    tree = F.struct(F.array(F.struct(F.struct(F.col("text"), F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), F.to_json(tree).alias("response"))


def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, one component box per lineitem, in the image of its part: (image_id, label, x, y, w, h)."""
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_partkey") / 26).alias("image_id"),
        n.alias("label"),
        (F.col("l_orderkey") % 60).cast("int").alias("x"),
        (F.col("l_suppkey") % 40).cast("int").alias("y"),
        (1 + F.col("l_quantity").cast("int") % 20).alias("w"),
        (1 + F.col("l_partkey") % 15).cast("int").alias("h"),
    )


def character_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, one recognised box per part, 26 parts an image: (image_id, char, x, y, w, h)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 26).alias("image_id"),
        F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26).cast("int") + 1, F.lit(1)).alias("char"),
        (k % 53).cast("int").alias("x"),
        (k % 37).cast("int").alias("y"),
        (3 + F.col("p_size") % 12).cast("int").alias("w"),
        (3 + k % 9).cast("int").alias("h"),
    )


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, one path per order; its first lines draw each with a command of their own: (path_id, d)."""

    def step(line, i):
        x, y = line["q"], line["p"] % 97
        return (
            F.when(i == 0, F.format_string("M%d %d", x, y))
            .when(i == 1, F.format_string("L%d,%d", x, y))
            .when(i == 2, F.format_string("h%d", x))
            .when(i == 3, F.format_string("V%d", y))
            .when(i == 4, F.format_string("q%d %d %d %d", x, y, y, x))
            .when(i == 5, F.format_string("C%d %d %d %d %d %d", x, y, x + 5, y + 3, y, x))
            .otherwise(F.format_string("l-%d %d", x, y))
        )

    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select("path_id", F.concat(F.array_join(F.transform("lines", step), ""), F.lit("Z")).alias("d"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, events as a stream of requests: (client, id, ts)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
