"""Token counts by distinct pre-token, without token ids.

The model's pieces hold white space only at their front, so no merge crosses from text into
white space and a text falls into pre-tokens (white space, then what is not) whose pieces add
up. One pass over the documents makes (document, pre-token, frequency) rows; these are
partitioned by pre-token, each distinct pre-token is counted once there and joined to its
rows, and partial sums go back to the documents.

Pre-tokens of a fixed head never travel: the ``HEAD`` most frequent ones of a bounded sample of
documents are counted beforehand and broadcast (at most ``HEAD`` strings of at most
``HEAD_CHARS`` code points). The sample decides only what is shuffled; every pre-token of every
whole text is counted. Longer pre-tokens are no part of the head, so they are salted: a rule line
or address that very many documents share is counted once in each of ``SALTS`` partitions and
meets in none.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted row
by row; a very long text or pre-token is counted whole, in a block of its own; further columns,
whatever their names, are not read; an empty table gives an empty table. Ties between merges are
the library's to break, as every distinct pre-token is handed to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import blocks, partitions_for

#: Head pre-tokens that are broadcast, the longest of them, and the documents sampled to choose them.
HEAD, HEAD_CHARS, SAMPLE = 65_536, 32, 4_000
#: Partitions of a pre-token too long for the head, and counted pre-tokens a task holds before it starts afresh.
SALTS, HELD = 64, 500_000

PRE_TOKEN = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each with its white space; the first with that of the model's prefix."""
    return PRE_TOKEN.findall(" " + text) if text else []


def encodable(text: str | None) -> list[str]:
    """What to hand the library for each pre-token of a text: all but the white space it puts in front itself.

    An empty string stands for a lone white space at the end, for which the library would return nothing (``lone_space``).
    """
    if not text:
        return []
    if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in pre_tokens(text)]
    return text.split(" ")


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def lone_space(model: str) -> list[int]:
    """The ids of a pre-token that is one white space: nothing is left of it to hand to the library."""
    return [processor(model).piece_to_id("▁")]


def piece_counts(model: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token; its first character is the prefix that the library adds itself."""
    lone = len(lone_space(model))
    return [len(ids) if len(t) > 1 else lone for t, ids in zip(tokens, processor(model).encode([t[1:] for t in tokens], num_threads=1))]


def head_counts(df: DataFrame, text: str, model: str) -> dict[str, int]:
    share = min(1.0, SAMPLE / max(1, df.count()))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                seen.update({p for p in pre_tokens(t or "") if len(p) <= HEAD_CHARS})
            yield pa.RecordBatch.from_pydict({"token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    sample = df.sample(share, seed=1).limit(2 * SAMPLE).select(text)
    ranked = sample.mapInArrow(found, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    tokens = [r.token for r in ranked.orderBy(F.desc("n"), "token").limit(HEAD).collect()]
    return dict(zip(tokens, piece_counts(model, tokens))) if tokens else {}


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document, as the library counts for ``model``."""
    known = df.sparkSession.sparkContext.broadcast(head_counts(df, text, model))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = known.value
        for batch in blocks(batches, 4 << 20):
            rows, sums, tokens, counts, tail = [], [], [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, before = 0, len(tokens)
                for token, n in Counter(pre_tokens(t or "")).items():
                    pieces = head.get(token)
                    if pieces is None:
                        tokens.append(token)
                        counts.append(n)
                    else:
                        total += n * pieces
                rows.append(row)
                sums.append(total)
                tail.append(len(tokens) - before)
            base = len(rows)
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array(rows, np.int64), np.repeat(np.array(rows, np.int64), tail)]) if base else np.empty(0, np.int64)),
                    pa.concat_arrays([batch.column(2).cast(pa.int64()), pa.nulls(len(tokens), pa.int64())]),
                    pa.concat_arrays([n_bytes, pa.nulls(len(tokens), pa.int64())]),
                    pa.array([None] * base + tokens, pa.string()),
                    pa.array(sums + counts, pa.int64()),
                ],
                ["row", "id", "n_bytes", "token", "n"],
            )
            for start in range(0, out.num_rows, 50_000):
                yield out.slice(start, 50_000)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, int] = {}
        for batch in batches:
            codes = batch.column(3).dictionary_encode()
            distinct = codes.dictionary.to_pylist()
            if len(counted) > HELD:
                counted = {}
            new = [t for t in distinct if t not in counted]
            if new:
                counted.update(zip(new, piece_counts(model, new)))
            pieces = np.array([counted[t] for t in distinct] + [1], np.int64)
            each = pieces[pc.fill_null(codes.indices, len(distinct)).to_numpy(zero_copy_only=False)]
            n = pa.array(batch.column(4).to_numpy(zero_copy_only=False) * each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n], ["row", "id", "n_bytes", "n"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(text), F.col(id_col).cast("long"))
    salt = F.when(F.length("token") > HEAD_CHARS, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0)
    spread = rows.mapInArrow(frequencies, "row long, id long, n_bytes long, token string, n long").repartition(
        partitions_for(df), F.coalesce("token", F.col("row").cast("string")), salt
    )
    sums = spread.mapInArrow(joined, "row long, id long, n_bytes long, n long").groupBy("row")
    whole = sums.agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return whole.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
