"""Phrase collocations: id n-grams as fixed-width binary keys, range-partitioned, radix-sorted and run-length counted.

1. Texts are cut into blocks of bounded size. Every block becomes a sequence of local word numbers,
   0 where a piece ends, and a list of its distinct words with their counts; both are written once.
2. Words of one language that occur ``least`` times in all get an id, a number from a global
   dictionary; each block's list is joined to it. A phrase that is frequent holds frequent words
   alone, so all other words break a piece as punctuation does.
3. A block meets its part of the dictionary, packs the ids of neighbouring words into
   keys of one width (big-endian ids, zeros behind shorter phrases), radix-sorts them and counts
   runs. Slices of the sorted keys go to ranges of keys whose bounds a sample of blocks gives.
4. A range gathers its slices, radix-sorts and counts runs again and keeps keys with ``least`` occurrences.
5. Frequent keys are cut, scored in exact integers, freed of phrases that a longer one holds, and ranked.

A block's dictionary is its own distinct words, so no dictionary is broadcast and none grows with the corpus
in a task. A hot word or phrase is one row per block before anything is shuffled. A range holds some ``RANGE``
bytes of slices; a key that fills one collapses as its slices are added up. The sample of at most ``SAMPLED``
blocks moves the bounds of ranges, never a result.

Defined results: null and empty texts have no words; a null language is ``und``; a very long text is
cut at the ends of pieces into several blocks, a single longer piece is a block of its own; repeated rows
count again; phrases of equal score are ordered by occurrences, then by their UTF-8 bytes; further columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.llm.bytewords import find_words, text_bytes
from vellumspark.llm.common import Scratch, blocks, partitions_for

#: Bytes of text in a block, of slices in a range of keys, and blocks whose keys set the bounds of ranges.
BLOCK, RANGE, SAMPLED = 8 << 20, 32 << 20, 8
#: Buckets in which dictionary words are numbered.
BUCKETS = 1024

#: Bytes that end a piece, and those that separate words inside one.
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(10, 14)]] = True
_WORD = ~_END
_WORD[[9, 32]] = False

BLOCKS = "block long, local int, lang string, word string, n long, sequence binary"


def _parts(lang: str, data: np.ndarray, most: int) -> Iterator[tuple[str, np.ndarray]]:
    """``data`` cut behind ends of pieces into parts of at most ``most`` bytes, where there are such ends."""
    while len(data) > most:
        ends = np.flatnonzero(_END[data[:most]])
        if not len(ends):
            ends = np.flatnonzero(_END[data[most:]])[:1] + most
        if not len(ends):
            break
        yield lang, data[: ends[-1] + 1]
        data = data[ends[-1] + 1 :]
    yield lang, data


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, bytes, offsets) of blocks of texts (lang, text), long texts cut."""
    for batch in blocks(batches, most):
        data, offsets = text_bytes(batch.column(1))
        langs = batch.column(0).to_pylist()
        if len(data) <= 2 * most:
            yield langs, data, offsets
            continue
        for lang, a, b in zip(langs, offsets[:-1], offsets[1:]):
            for lang_, part in _parts(lang, data[a:b], most):
                yield [lang_], part, np.array([0, len(part)])


def coded_blocks(df: DataFrame, text: str, lang: str, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of texts: one row (block, sequence) with local word numbers as 32-bit integers, 0 between pieces,
    and a row (block, local, lang, word, n) for each distinct word of a language in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for langs, data, offsets in _texts(batches, block_bytes):
            found = find_words(data, offsets, _WORD)
            if not len(found.starts):
                continue
            inside = _WORD[found.data]
            ends = np.append(0, np.cumsum(found.ends - found.starts))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found.starts), [None, pa.py_buffer(ends), pa.py_buffer(found.data[inside].tobytes())]).dictionary_encode()
            codes = pa.array(langs, pa.string()).dictionary_encode()
            spoken = np.repeat(codes.indices.to_numpy(), np.diff(found.first)).astype(np.int64)
            size = len(words.dictionary)
            own, local, counts = np.unique(spoken * size + words.indices.to_numpy(), return_inverse=True, return_counts=True)
            # A word stands in the same piece as the one before it unless a text or a piece ends between them.
            cuts = np.append(0, np.cumsum(_END[found.data]))
            apart = np.zeros(len(local), bool)
            apart[1:] = cuts[found.starts[1:]] != cuts[found.starts[:-1]]
            apart[found.first[:-1][found.first[:-1] < len(local)]] = True
            sequence = np.zeros(len(local) + int(apart.sum()), np.int32)
            sequence[np.arange(len(local)) + np.cumsum(apart)] = local + 1
            n = len(own)
            rows = [
                pa.array(np.full(n + 1, block)),
                pa.array(np.append(np.arange(1, n + 1), 0).astype(np.int32)),
                pa.concat_arrays([codes.dictionary.take(pa.array(own // size)), pa.nulls(1, pa.string())]),
                pa.concat_arrays([words.dictionary.take(pa.array(own % size)).cast(pa.large_string()).cast(pa.string()), pa.nulls(1, pa.string())]),
                pa.array(np.append(counts, 0)),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([sequence.tobytes()], pa.binary())]),
            ]
            yield pa.RecordBatch.from_arrays(rows, ["block", "local", "lang", "word", "n", "sequence"])
            block += 1

    return df.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def dictionary(coded: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, n) of the words that occur ``least`` times in a language; ids are dense, from 1."""
    words = coded.where("sequence is null").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)))
    turn = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word")).cast("long")
    return words.select(((turn - 1) * BUCKETS + F.col("bucket") + 1).alias("id"), "lang", "word", "n")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts rows of big-endian keys (n, bytes): stable passes over 16-bit digits, last digit first.

    numpy's stable sort of 16-bit numbers is a radix sort; digits that are all alike take no pass.
    """
    digits = np.ascontiguousarray(keys).view(">u2")
    order = np.arange(len(digits))
    for k in reversed(range(digits.shape[1])):
        digit = digits[order, k].astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their counts added up)."""
    order = radix_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def packed(ids: np.ndarray, longest: int, width: int) -> np.ndarray:
    """Keys of all phrases of 2 to ``longest`` neighbouring ids, none of them 0: rows of ``longest * width`` bytes."""
    kind = f">u{width}"
    found = []
    whole = ids != 0
    for size in range(2, longest + 1):
        n = max(0, len(ids) - size + 1)
        good = np.ones(n, bool)
        for k in range(size):
            good &= whole[k : k + n]
        at = np.flatnonzero(good)
        keys = np.zeros((len(at), longest), kind)
        for k in range(size):
            keys[:, k] = ids[at + k]
        found.append(keys.view(np.uint8).reshape(-1, longest * width))
    return np.concatenate(found)


def counted_ngrams(coded: DataFrame, words: DataFrame, longest: int, least: int, width: int, ranges: int) -> DataFrame:
    """(key, a): every phrase of 2 to ``longest`` dictionary words that occurs ``least`` times."""
    size = longest * width
    kind = f"S{size}"

    def block_keys(sequence: pa.Table, numbers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        local = np.frombuffer(sequence["sequence"][0].as_buffer(), np.int32)
        ids = np.zeros(int(local.max()) + 1, np.uint64)
        ids[numbers["local"].to_numpy()] = numbers["id"].to_numpy().astype(np.uint64)
        return run_lengths(packed(ids[local], longest, width))

    def met(table: DataFrame, chosen: DataFrame | None, function, schema: str) -> DataFrame:
        table = table if chosen is None else table.join(F.broadcast(chosen), "block", "left_semi")
        sequences = table.where("sequence is not null").select("block", "sequence")
        numbers = table.where("sequence is null").join(words.select("id", "lang", "word"), ["lang", "word"]).select(F.col("block").alias("of"), "local", "id")
        return sequences.groupBy("block").cogroup(numbers.groupBy("of")).applyInArrow(function, schema)

    def sampled(sequence: pa.Table, numbers: pa.Table) -> pa.Table:
        keys = block_keys(sequence, numbers)[0] if sequence.num_rows and numbers.num_rows else np.empty((0, size), np.uint8)
        return pa.table({"key": pa.array([k.tobytes() for k in keys[:: max(1, len(keys) // (20 * ranges))]], pa.binary())})

    some = coded.where("sequence is not null").select("block").orderBy(F.xxhash64("block")).limit(SAMPLED)
    sample = np.sort(np.array([r.key for r in met(coded, some, sampled, "key binary").collect()], kind))
    bounds = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample

    def dealt(sequence: pa.Table, numbers: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes, bytes]] = []
        if sequence.num_rows and numbers.num_rows:
            keys, counts = block_keys(sequence, numbers)
            edges = [0, *np.searchsorted(keys.reshape(-1).view(kind), bounds).tolist(), len(keys)]
            rows = [(k, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate((("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task is a range: equal keys are in one task, and what it holds is bounded by its distinct keys and ``RANGE``.
        keys, counts = [np.empty((0, size), np.uint8)], [np.empty(0, np.int64)]
        held = 0
        for batch in batches:
            for k, n in zip(batch.column(1), batch.column(2)):
                keys.append(np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, size))
                counts.append(np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64))
                held += keys[-1].nbytes
                if held > RANGE:
                    whole = run_lengths(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [whole[0]], [whole[1]], 0
        found, n = run_lengths(np.concatenate(keys), np.concatenate(counts))
        found, n = found[n >= least], n[n >= least]
        for at in range(0, len(n), 10_000):
            some = found[at : at + 10_000]
            offsets = np.arange(0, size * len(some) + 1, size, dtype=np.int32)
            column = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(some.tobytes())])
            yield pa.RecordBatch.from_arrays([column, pa.array(n[at : at + 10_000])], ["key", "a"])

    slices = met(coded, None, dealt, "range int, keys binary, counts binary")
    return slices.repartitionById(len(bounds) + 1, "range").mapInArrow(counted, "key binary, a long")


def scored(counts: DataFrame, words: DataFrame, longest: int, width: int) -> DataFrame:
    """(lang, key, size, a, l, r, score) of every phrase: its lowest-scoring cut, the first among equals.

    Cuts are rows that meet the counts of both their parts; joins that a frequent part makes uneven are split by the adaptive planner.
    """
    blank = F.lit(b"\0" * (longest * width))
    pad = lambda x: F.substring(F.concat(x, blank), 1, longest * width)
    whole = counts.withColumn("size", _size(longest, width))
    single = words.select(pad(_packed_id(F.col("id"), width)).alias("key"), F.col("n").alias("a"), "lang")
    parts = single.unionByName(counts.select("key", "a", F.lit(None).cast("string").alias("lang")))
    cut = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"left": pad(F.substring("key", F.lit(1), F.col("k") * width)), "right": pad(F.substring("key", F.col("k") * width + 1, F.lit(longest * width)))})
    cut = cut.join(parts.select(F.col("key").alias("left"), F.col("a").alias("l"), "lang"), "left")
    cut = cut.join(parts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    # 19 digits a count: the square times a million and the product both fit 38, and the quotient of the two is exact.
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    rows = cut.groupBy("key", "size", "a").agg(best.alias("b"), F.max("lang").alias("lang"))
    return rows.select("lang", "key", "size", "a", "b.l", "b.r", "b.score")


def _packed_id(number, width: int):
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def _size(longest: int, width: int):
    """Words of a key: those whose ids are not 0."""
    return sum((F.substring("key", k * width + 1, width) != F.lit(b"\0" * width)).cast("int") for k in range(longest))


def outstanding(phrases: DataFrame, longest: int, width: int, share: int) -> DataFrame:
    """``phrases`` without those inside a longer one that has ``share`` per cent of their occurrences."""
    blank = F.lit(b"\0" * (longest * width))
    spots = [(size, at) for size in range(2, longest) for at in range(longest - size + 1)]
    inner = F.array(*[F.when(F.col("size") >= at + size, F.when(F.col("size") > size, F.substring(F.concat(F.substring("key", at * width + 1, size * width), blank), 1, longest * width))) for size, at in spots])
    if not spots:
        return phrases
    longer = phrases.select(F.explode(inner).alias("key"), "a").where("key is not null").groupBy("key").agg(F.max("a").alias("most"))
    return phrases.join(longer, "key", "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most")


def front(phrases: DataFrame, top: int) -> DataFrame:
    """The phrases of each language that can be among its first ``top`` by score: a histogram of scores, 100 bins to
    an octave, tells the bin that the last of them falls in; only bins down to that one are kept."""
    bin_ = F.floor(100 * F.log2(F.col("score") + F.lit(1.0)))
    binned = phrases.withColumn("bin", bin_)
    sizes = binned.groupBy("lang", "bin").agg(F.count("*").alias("size"))
    above = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lowest = sizes.withColumn("above", above).where(F.col("above") < top).groupBy("lang").agg(F.min("bin").alias("lowest"))
    return binned.join(lowest, "lang").where("bin >= lowest").drop("bin", "lowest")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, block_bytes: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    a: occurrences; l and r: those of the two parts of the lowest-scoring cut; n: words of the language;
    score: a million times a * a / (l * r), rounded down. Phrases that occur fewer than ``least`` times, or stand inside a longer one with
    ``share`` per cent of their occurrences, are left out. Counts below a thousand million million are exact.
    """
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    scratch = Scratch(df.sparkSession)
    coded = scratch.stored(coded_blocks(df, text, lang, block_bytes))
    words = scratch.stored(dictionary(coded, least))
    most, tokens = words.agg(F.max("id"), F.sum("n")).first()
    width = 4 if (most or 0) < 1 << 32 else 8
    ranges = max(partitions_for(df), -(-(tokens or 0) * (longest - 1) * (longest * width + 4) // RANGE))
    counts = scratch.stored(counted_ngrams(coded, words, longest, least, width, ranges))
    ranked = scratch.stored(front(outstanding(scratch.stored(scored(counts, words, longest, width)), longest, width, share), top))
    spots = F.sequence(F.lit(0), F.col("size") - 1)
    places = ranked.select("key", F.explode(spots).alias("at")).withColumn("id", F.conv(F.hex(F.substring("key", F.col("at") * width + 1, F.lit(width))), 16, 10).cast("long"))
    spelled = places.join(words.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sums = coded.where("sequence is null").groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = ranked.join(spelled, "key").join(sums, "lang").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    found = Scratch(df.sparkSession).stored(rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    scratch.clear()
    return found
