"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a DataFrame expression; the rows of ``RULES`` compile into one boolean
column. No user function, shuffle or join takes part: a document is judged by the task that
scans it, so nothing is skewed by a hot source or a group of copies.

A word is hashed once; hashes of neighbouring words join to those of two, four and eight, so a window
costs three joins of two numbers.

Defined results: a null or empty text has no words and no lines, all its ratios are 0 and the
least-length rule rejects it; a very long text is judged whole, its arrays in one row; repeated rows
are judged one by one; a metric equal to a threshold is within it; columns that bear the name of a metric are replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import word_array


class Rule(NamedTuple):
    """``metric`` must lie between ``low`` and ``high``, both included; None leaves a side open."""

    metric: str
    low: float | None
    high: float | None


#: Stop words of the four languages served. Fixed values.
STOP_WORDS = (
    "the be to of and that have with in is a was on are as for it this "
    "der die das und den von mit ist zu im ein eine nicht auf für "
    "le la les de des et un une que dans est pour du en "
    "el los las con por para del se y"
).split()

#: The threshold table. Lengths in words or code points, ratios per word or per line.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("n_stop_words", 2, None),
    Rule("stop_words_per_word", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)

#: Characters that begin a bulleted line.
BULLETS = ("-", "*", "•", "‣")

#: Metrics that exist while the projections build on each other, then go.
HELD = ("_words", "_lines", "_windows", "_stops")


def paired(hashes: Column, apart: int) -> Column:
    """Hashes of windows of twice the width: each joined with the one ``apart`` places on."""
    return F.zip_with(F.slice(hashes, 1, F.size(hashes) - apart), F.slice(hashes, apart + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def repeated_window_words(windows: Column, width: int) -> Column:
    """Words that lie in a window found twice or more, each counted once.

    Only a text that has equal windows sorts them; their places then add up as a union of
    intervals.
    """
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_union(_repeated(ordered), width))


def _repeated(ordered: Column) -> Column:
    return F.sort_array(
        F.transform(
            F.filter(
                F.zip_with(
                    ordered,
                    F.zip_with(
                        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(ordered, 1, F.size(ordered) - 1)),
                        F.slice(ordered, 2, F.size(ordered)),
                        lambda before, after: F.struct(before["h"].alias("before"), after["h"].alias("after")),
                    ),
                    lambda x, near: F.struct(x["i"].alias("i"), (x["h"].eqNullSafe(near["before"]) | x["h"].eqNullSafe(near["after"])).alias("twice")),
                ),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )


def _union(places: Column, width: int) -> Column:
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + width).alias("end"), (s["n"] + i + width - F.greatest(s["end"], i)).alias("n")),
        lambda s: s["n"],
    )


def with_metrics(df: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Add every metric of the rules; ``width``, of the windows searched for repeats, is a power of two.

    Arrays that several metrics read are projections of their own, so a text is split and hashed once."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    t = F.coalesce(F.col(text), F.lit(""))
    per = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    df = df.withColumn("_words", word_array(F.col(text)))
    forms = list(dict.fromkeys(STOP_WORDS + [w.capitalize() for w in STOP_WORDS] + [w.upper() for w in STOP_WORDS]))
    stopped = lambda x: F.filter(x, lambda w: w.isin(*forms))
    df = df.withColumns(
        {
            "_lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != ""),
            "_stops": stopped(F.col("_words")),
            "_windows": F.when(F.size("_words") >= width, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    for k in range(width.bit_length() - 1):
        df = df.withColumn("_windows", F.when(F.size("_words") >= width, paired(F.col("_windows"), 1 << k)).otherwise(F.col("_windows")))
    ends = lambda x: x.endswith("...") | x.endswith("…")
    n, lines = F.size("_words"), F.size("_lines")
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (lines - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_windows"), width).cast("long"),
            "n_stop_words": F.size(F.array_distinct("_stops")),
            "stop_words_per_word": per(F.size("_stops"), n),
            "bullet_line_ratio": per(F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x, F.lit(" \t")), 1, 1).isin(*BULLETS))), lines),
            "ellipsis_line_ratio": per(F.size(F.filter("_lines", lambda x: ends(F.rtrim(x, F.lit(" \t\r"))))), lines),
        }
    )
    df = df.withColumns(
        {
            "mean_word_chars": per(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": per(F.col("n_symbols"), F.col("n_words")),
            "dup_line_ratio": per(F.col("n_dup_lines"), F.size("_lines")),
        }
    )
    return df.drop(*HELD)


def compiled(rules: Iterable[Rule]) -> Column:
    """The table as one boolean expression; an empty table keeps everything."""
    sides = [side for r in rules for side in (None if r.low is None else F.col(r.metric) >= r.low, None if r.high is None else F.col(r.metric) <= r.high) if side is not None]
    return reduce(Column.__and__, sides, F.lit(True))


def quality_rules(df: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """``df`` with its metrics, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of
    the words in repeated windows of eight. ``kept``: not failed so, and within all ``rules``.
    """
    df = with_metrics(df, text)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df`` alone.

    The row number ties the filter to the projection that computes the verdict; without it the
    optimizer would copy every metric's expression into the filter, once for each use.
    """
    packed = df.select(F.col(text).alias("text"), F.struct(*df.columns).alias("_all"))
    judged = quality_rules(packed).withColumn("_row", F.monotonically_increasing_id())
    return judged.where((F.col("_row") >= 0) & F.col("kept")).select("_all.*")
