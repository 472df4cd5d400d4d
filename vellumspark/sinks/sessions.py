"""Saved sessions, playgrounds and drawing progress: a log of saves and clears, and a keyed store of what it leaves.

The store is dealt into buckets by session. A log is merged into the buckets that hold its sessions alone; the others are
neither read nor written. A slot keeps the sequence number of its last save or clear, so logs may come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.session import scratch_dir

#: What a session keeps, and the buckets of a store.
SLOTS, BUCKETS = ("session", "playground", "draw"), 64
LOG = "session_id long, slot string, seq long, json string"
STORE = f"{LOG}, bucket int"
PLAYGROUND = "text STRING, fontSize DOUBLE, noteColorId STRING, _broken STRING"


def last_words(log: DataFrame) -> DataFrame:
    """(session_id, slot, seq, json): the last save or clear of each slot of a log (session_id, slot, seq, json); json is null after a clear.

    A row without json clears its slot, one without a slot all slots of its session. Every row counts
    for one slot, so a session of any length is combined map-side; of rows of one sequence number a save beats a clear, the greater text the lesser.
    """
    rows = log.withColumn("slot", F.explode(F.when(F.col("slot").isNull(), F.array(*map(F.lit, SLOTS))).otherwise(F.array("slot"))))
    last = rows.groupBy("session_id", "slot").agg(F.max(F.struct("seq", "json")).alias("last"))
    return last.select("session_id", "slot", "last.seq", "last.json")


def current(log: DataFrame) -> DataFrame:
    """(session_id, slot, json) that a log leaves."""
    return last_words(log).where("json is not null").select("session_id", "slot", "json")


def _store(spark: SparkSession, path: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(STORE).parquet(path) if there else spark.createDataFrame([], STORE)


def save(log: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merge ``log`` into the store at ``path``: buckets of its sessions are read, merged and replaced whole.

    What replaces them is written aside first, as a bucket is not read while it is overwritten. ``buckets`` is the store's for good.
    """
    spark = log.sparkSession
    dealt = last_words(log).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    aside = scratch_dir(spark)
    dealt.write.parquet(f"{aside}/log")
    new = spark.read.schema(dealt.schema).parquet(f"{aside}/log")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    before = _store(spark, path).where(F.col("bucket").isin(touched)) if touched else spark.createDataFrame([], STORE)
    merged = last_words(before.select("session_id", "slot", "seq", "json").unionByName(new.select("session_id", "slot", "seq", "json")))
    merged = merged.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    merged.write.parquet(f"{aside}/merged")
    rows = spark.read.schema(merged.schema).parquet(f"{aside}/merged")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, slot, json) of the store at ``path``."""
    return _store(spark, path).where("json is not null").select("session_id", "slot", "json")


def corrupt(json: Column) -> Column:
    """Whether a saved text is no JSON."""
    return json.isNotNull() & F.try_parse_json(json).isNull()


def drop_corrupt(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Clear the entries of the store that are no JSON; buckets without such entries stay as they are."""
    broken = _store(spark, path).where(corrupt(F.col("json"))).select("session_id", "slot", (F.col("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("json"))
    save(broken, path, buckets)


def playground(json: Column) -> Column:
    """(text, fontSize, noteColorId) of a saved playground; null if broken."""
    saved = F.from_json(json, PLAYGROUND, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.when(saved.isNotNull() & saved["_broken"].isNull(), F.struct(saved["text"].alias("text"), saved["fontSize"].alias("fontSize"), saved["noteColorId"].alias("noteColorId")))


def draw_progress(json: Column) -> Column:
    """The data URL of each drawn letter; null if broken or empty."""
    drawn = F.from_json(json, "MAP<STRING, STRING>")
    return F.when(F.size(drawn) > 0, drawn)
