"""Toxicity scores of whole texts by a bidirectional recurrent network over overlapping windows.

The network is trained on the driver from a bounded sample of labelled rows (``SAMPLE`` of each
label, one row of an id, by hash of the id) and broadcast; its size is fixed. Every text is then scored where it
is scanned, window after overlapping window to its end, and keeps its highest window. There is
no shuffle, and memory follows a block of texts.

Defined results: a null or empty text is one window of padding; a very long one is scored to its
end, in a block of its own; repeated rows score alike, and of several texts or labels of one id
the least text and the higher label train; ids with the same hash go by their order; a sample that
lacks one of the labels scores every text with the share of toxic rows in it (0 if empty); further
columns, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import gru
from vellumspark.llm.common import blocks

#: Labelled rows of each label that train the network, at most, unless told otherwise.
SAMPLE = 1200


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int) -> tuple[list[str], np.ndarray]:
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    # At most ``sample`` ids of each label, and one text of each.
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64)


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE
) -> DataFrame:
    """(id, held_out, score, predicted) of each document; rows held out by the crc32 of their id train nothing.

    ``sample``: the most labelled rows of each label that train the network.
    """
    texts, y = training_rows(df, labels, id_col, text, label, sample)
    flat = float(y.mean()) if len(y) else 0.0
    model = df.sparkSession.sparkContext.broadcast(gru.train(texts, y) if 0 < flat < 1 else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2 << 20):
            every = batch.column(1).to_pylist()
            scores = gru.text_scores(model.value, every) if model.value else np.full(len(every), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    scored = df.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
