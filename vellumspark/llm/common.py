"""Helpers shared by the training-data operators: shared scratch tables and text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.session import scratch_dir

#: Bytes that a row of a block counts beside its text.
ROW = 64
#: The white space that separates words: space and the control characters 9 to 13.
WHITE = "[\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession).stored(df, partition_by)


class Scratch:
    """Tables of one job in the shared folder; ``clear`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = scratch_dir(self.spark)
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 3)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, keep: int = 0) -> None:
        """Remove all tables but the last ``keep``."""
        going, self.paths = (self.paths[:-keep], self.paths[-keep:]) if keep else (self.paths, [])
        context = self.spark.sparkContext
        for path in going:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions: the session's setting, which the cluster owner sizes to the data."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_array(text):
    """The words of a text column as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def blocks(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slice or gather record batches (first column an id, second a string) into blocks of about
    ``text_bytes`` of text, so that memory follows the block and not Arrow's row count. A row counts
    ``ROW`` bytes beside its text, and a single longer text makes a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n) + ROW
            if size >= text_bytes:
                held.append(batch.slice(start, i + 1 - start))
                yield _joined(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)
