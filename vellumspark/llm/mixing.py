"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token target. Among all document rates ``r`` in [0, cap] that meet it, those
of least relative entropy to one copy each are ``min(cap, exp(lambda * size / scale))`` with one
multiplier ``lambda`` per source: the convex dual. Newton steps on the logarithm of the
constraint find it. Rates depend on a document's source and size alone, so the iterations run
on the table of cells (source, size, count), which grows with the number of distinct sizes and
not with the documents. Rates then become whole copies: cumulative rounding along the cells,
a correction that moves what is left over with the smallest documents, and a ranking by hash
inside each cell. Large cells are cut into buckets before they are ranked, so a source or a
group of copies that holds a third of all rows never meets in one task. The list of sources, one
short row each with its sums, is ordered and filled in one task; cells and documents never are.

Sums over tasks are of decimals, so they do not depend on the order in which tasks end and reruns
agree to the last copy.

Defined results: null or empty texts have size 0 and take 0; null sources form one source, the
last; repeated rows are mixed row by row, rows of equal id and size may change places; a very long
text is one of its size; further columns, whatever their names, are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.llm.common import Scratch, partitions_for, word_array

#: Newton steps at most, and the words by which every source may miss its target when they end: less than one document has.
STEPS, MISS = 40, 0.5
#: Documents ranked together when a cell's copies are dealt out.
BUCKET = 1000


def sized(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(id, source, present, size): ``present`` is false for the null source, which sorts last."""
    return df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.col(source).isNotNull().alias("present"),
        F.size(word_array(F.col(text))).cast("long").alias("size"),
    )


def targets(cells: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """(source, present, source_size, target): water filling of ``budget`` times all tokens by weight,
    where a source stops at ``cap`` times its own tokens and the rest is shared out again."""
    sums = cells.groupBy("source", "present").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everyone = W.orderBy(F.col("present").desc(), "source")
    turn = (F.row_number().over(everyone) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = sums.withColumns({"weight": weight, "limit": cap * F.col("source_size"), "all": F.sum("source_size").over(W.partitionBy())})
    fullest = W.orderBy(F.col("limit") / F.col("weight"), F.col("present").desc(), "source")
    before = F.coalesce(F.sum("limit").over(fullest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fullest.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", (budget * F.col("all") - before) / after)
    level = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(W.partitionBy())
    filled = F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level["level"] * F.col("weight")))
    return ranked.select("source", "present", "source_size", filled.alias("target"))


def exact_sum(x: Column) -> Column:
    """The sum of doubles to nine decimals, the same in any order."""
    return F.sum(x.cast("decimal(28,9)")).cast("double")


def multipliers(cells: DataFrame, goals: DataFrame, cap: float, steps: int = STEPS, within: Scratch | None = None) -> DataFrame:
    """Newton iterations until every source is within ``MISS`` words of its target, or the rates meet it as nearly as numbers do.

    ``lambda`` is null where the target leaves no choice (every rate is the cap); ``miss`` is the words by which the rates before the last step
    missed. One number per step reaches the driver. A source that is not there after ``steps`` is an error.
    """
    scratch = within or Scratch(cells.sparkSession)
    spread = cells.groupBy("source", "present").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.greatest(F.sum(F.col("size") * F.col("n")), F.lit(1))).alias("scale"))
    free = F.col("target") < cap * F.col("source_size") * (1 - 1e-12)
    state = scratch.stored(goals.join(spread, ["source", "present"]).withColumns({"lambda": F.when(free, F.lit(0.0)), "miss": F.lit(None).cast("double")}))
    tilt = F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(50.0)))
    tokens = F.col("size") * F.col("n")
    worst = 0.0
    for _ in range(steps):
        reached = (
            cells.join(state, ["source", "present"])
            .where(F.col("lambda").isNotNull() & (F.col("size") > 0))
            .groupBy(*state.columns)
            .agg(
                exact_sum(tokens * F.least(tilt, F.lit(cap))).alias("f"),
                exact_sum(F.when(tilt < cap, tokens * tilt * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        step = F.when(F.col("slope") > 0, (F.log("target") - F.log("f")) * F.col("f") / F.col("slope")).otherwise(-F.col("lambda") / 2)
        moved = reached.withColumn("lambda", F.col("lambda") + F.greatest(F.least(step, F.lit(4.0)), F.lit(-4.0))).withColumn("miss", F.abs(F.col("f") - F.col("target")))
        state = scratch.stored(moved.drop("f", "slope").unionByName(state.where("lambda is null")))
        # Beyond some 10^12 words doubles hold a target to less than half a word; there a share of it is as near as they come.
        worst = state.agg(F.max(F.col("miss") / F.greatest(F.lit(MISS), F.col("target") * 1e-12))).first()[0]
        if worst is None or worst <= 1:
            return state
    if steps:
        raise ArithmeticError(f"after {steps} steps a source misses its target by {worst * MISS:.3g} words")
    return state


def rounded(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Copies of each cell in all: (source, present, size, n, copies, source_size, target)."""
    tilt = F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.lit(50.0)))
    rated = cells.join(state, ["source", "present"]).withColumn("rate", F.when(F.col("lambda").isNull(), F.lit(float(cap))).otherwise(F.least(tilt, F.lit(float(cap)))))
    group = W.partitionBy("source", "present")
    large = group.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    rated = rated.withColumn("running", F.sum(part).over(large)).withColumn("part", part)
    copies = F.col("n") * F.floor("rate") + F.floor(F.col("running") + 0.5) - F.floor(F.col("running") - F.col("part") + 0.5)
    rated = rated.withColumn("copies", F.greatest(F.lit(0), F.least(copies, cap * F.col("n"))).cast("long"))
    rated = rated.withColumn("rest", F.col("target") - F.sum(F.col("size") * F.col("copies")).over(group))
    room = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.least("n", cap * F.col("n") - F.col("copies"))).otherwise(F.least("n", "copies"))
    rated = rated.withColumn("room", room)
    small = group.orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("used", F.coalesce(F.sum(F.col("size") * F.col("room")).over(small), F.lit(0)))
    wanted = F.floor((F.abs("rest") - F.col("used")) / F.greatest("size", F.lit(1)) + 0.5)
    moved = F.greatest(F.lit(0), F.least("room", wanted))
    rated = rated.withColumn("copies", (F.col("copies") + F.signum("rest") * moved).cast("long"))
    return rated.select("source", "present", "size", "n", "copies", "source_size", "target")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    cap: int = 2,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``df``: the id, source, size, source_size, target, copies and taken.

    Sources take their weight from ``weights`` in code-point order, repeating, the null source
    last. ``copies`` (0 to ``cap``) is how often the mix takes the document and ``taken`` the words
    that makes. The same table, weights and seed give the same copies.
    """
    kept, scratch = Scratch(df.sparkSession), Scratch(df.sparkSession)
    docs = kept.stored(sized(df, id_col, text, source))
    cells = scratch.stored(docs.groupBy("source", "present", "size").agg(F.count("*").alias("n")))
    state = multipliers(cells, targets(cells, weights, budget, float(cap)), float(cap), within=scratch)
    dealt = kept.stored(rounded(cells, state, cap))
    scratch.clear()
    bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.floor(F.col("n") / BUCKET) + 1)
    keys = ["source", "present", "size"]
    rows = docs.join(dealt, keys).withColumn("bucket", bucket).repartition(partitions_for(df), *keys, "bucket")
    own = W.partitionBy(*keys, "bucket")
    place = F.row_number().over(own.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id"))
    share = (F.col("copies") % F.col("n")) * F.count("*").over(own) / F.col("n")
    luck = F.pmod(F.xxhash64(*keys, "bucket", F.lit(seed + 2)), F.lit(1 << 20)) / float(1 << 20)
    more = place <= F.when(F.col("n") < BUCKET, F.col("copies") % F.col("n")).otherwise(F.floor(share + luck))
    taken = F.floor(F.col("copies") / F.col("n")) + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("taken_copies", F.least(taken, F.lit(cap)).cast("int"))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("present"), F.col("source")).alias(source),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        F.col("taken_copies").alias("copies"),
        (F.col("taken_copies") * F.col("size")).cast("long").alias("taken"),
    )
