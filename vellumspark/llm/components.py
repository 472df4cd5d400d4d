"""Connected components of a table of links, by star contraction on DataFrames.

Large-star and small-star steps turn the links into a forest of stars whose centres are the
smallest members. Each step is a minimum per vertex and a join, so a hub with very many links is
combined map-side and its join can be split. The links are written to the shared folder after
every round, and those of the round before removed; only a count and a check sum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where(F.col("b") > F.col("a") if large else F.col("b") < F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, within: Scratch | None = None) -> DataFrame:
    """(member, component) for each id that occurs in ``links`` (columns a and b): the smallest id it reaches.

    Null ends and links of an id with itself are left out; an empty table gives an empty table.
    The table that the result reads is handed to ``within``, to be removed with what that holds.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(links)
    while seen[0]:
        links = scratch.stored(_star(_star(links, True), False))
        now = mark(links)
        scratch.clear(keep=1)
        if now == seen:
            break
        seen = now
    if within:
        within.paths += scratch.paths
    return links.select(F.col("a").alias("member"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("member"), F.col("b").alias("component")).distinct())
