"""The corpus pipeline: documents in, encoded documents out, one written table between stages.

Every stage takes (spark, docs, sf_dir) and judges all that its predecessor kept; all but the
last return the columns of documents, further ones among them, whatever their names. Each stage states
what it does with nulls, empty and very long texts, ties and repeated rows; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.common import stored, table
from vellumspark.llm.mixing import mix_sources
from vellumspark.llm.ngramjoin import ngram_components
from vellumspark.llm.pii import redact
from vellumspark.llm.quality import keep_good
from vellumspark.llm.queries import tokenizer
from vellumspark.llm.spm import encode


def rows_of(docs: DataFrame) -> DataFrame:
    """(id, row): each document packed into a struct, so that no column of it meets a stage's own columns."""
    return docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them, very long ones are judged whole.

    Rows are judged one by one by their text alone: equal rows alike, whatever their id and other columns hold.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays, once.

    Documents without an id, and those whose text is null or has no words, are linked with nothing and stay. Rows
    that share an id and a text collapse to one of them, whichever comes first; only ids that stand in several rows are
    looked at for that. Very long texts are compared whole.
    """
    firsts = ngram_components(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    kept = rows_of(docs).join(firsts, "id", "left_semi")
    repeated = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    digest = F.coalesce(F.sha2(F.col("row").getField("text"), 256), F.lit(""))
    more = kept.join(repeated, "id", "left_semi").withColumn("digest", digest).dropDuplicates(["id", "digest"])
    alone = rows_of(docs).where("id is null")
    return kept.join(repeated, "id", "left_anti").unionByName(more.drop("digest")).unionByName(alone).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; all rows stay.

    Null texts stay null and empty ones empty, very long ones are searched whole; finds that overlap in a text give
    way together, to the kind of the first; equal rows are treated alike.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the result as often as the mix takes them.

    Each row is mixed for itself, under a number that this stage writes beside it: rows without an id and rows that
    share one get copies of their own. Null sources are one source; rows whose text is null or has no words are taken no
    time; equal rows may be taken unequally, as copies are dealt one by one. Rows of one size and source are equals, and a hash of
    the row's number decides among them.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")))
    sizes = numbered.select("number", F.col("row").getField("text").alias("text"), F.col("row").getField("source").alias("source"))
    copies = mix_sources(sizes, id_col="number").where("copies > 0").select("number", "copies")
    taken = numbered.join(copies, "number")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, row by row; none for a null or empty text, all of a very long one."""
    return encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Similarity joins, transducers and merges have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
