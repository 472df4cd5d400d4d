"""Token ids as fixed-stride binary shards in training order.

Documents become sequences of ``length`` token ids: a document's ids and an end mark, cut every
``length`` and padded. Sequences are numbered from 0 without gaps (a running sum over the tasks
that wrote them), and a keyed Feistel permutation, walked along its cycle until it falls inside
the range, gives each a global slot. Slots are dealt by range, one shard to a task: shard k holds
slots k * S to (k + 1) * S - 1 in order, as records of one stride, so the record of slot s starts
at byte (s mod S) * stride of shard s div S. A reader goes on from any slot by seeking.

Texts are tokenised once; their ids are written, compressed and without padding, to the shared
folder, each document with the task that made it and the number of its first sequence there.
What numbers a sequence is thus in that table, so tasks repeated or dealt anew after a lost
executor find the same slots. Records cross the shuffle unpadded too and are filled up behind it.
Shards are written by Spark's text writer from raw bytes, so they go through its commit protocol
to whatever store the path names; the record's last byte is the line end. They are written in two
waves, each of a range of shards that reads the ids again, and a wave's shuffle is removed before
the next one's begins, so the disk never holds the whole shuffle beside all shards. The ids stay
until the last shard is committed, and only the last wave writes ``_SUCCESS``.

Defined results: a null or empty text is one sequence with the end mark alone; a null id is
written as -1; repeated rows give repeated sequences; a very long text is many sequences, numbered
in a row and spread over the shards like all others; further columns, whatever their names, are
not read; an empty table writes no shard and gives an empty table. Slots have no ties: the permutation
gives every sequence number a slot of its own, and equal rows have numbers of their own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.common import Scratch, blocks
from vellumspark.llm.tokencount import encodable, lone_space, processor
from vellumspark.session import scratch_dir

#: A record: document id, number of the sequence in it, ids that count, the ids, a line end.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4")])
LENGTH, ROUNDS = 256, 6
#: Records of a shard: at least, at most, and shards aimed at in between.
LEAST, MOST, SHARDS = 1 << 13, 1 << 18, 2048


def record(length: int) -> np.dtype:
    return np.dtype([*HEADER.descr, ("ids", "<u2", (length,)), ("line_end", "u1")])


def shard_size(total: int) -> int:
    """Records of a shard for so many sequences: a power of two, so that files are neither many nor tiny."""
    return min(MOST, max(LEAST, 1 << max(0, total // SHARDS - 1).bit_length()))


#: Pre-tokens whose ids a Python worker holds before it starts afresh.
HELD = 400_000


class Coder:
    """Ids of texts; the ids of pre-tokens met before are at hand, ``HELD`` of them and a block's.

    Texts are split and their distinct pre-tokens found and looked up by Arrow; Python sees the new ones.
    """

    def __init__(self, model: str):
        self.model = model
        self.forget()

    def forget(self) -> None:
        # No pre-token is empty but a lone white space less the one the library adds.
        self.known = pa.array([""], pa.large_string())
        self.ids = np.array(lone_space(self.model), np.uint16)
        self.ends = np.array([0, len(self.ids)])

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, of an array of distinct ones, among those known; new ones are made known."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        at[np.isnan(at)] = len(self.known) + np.arange(len(new))
        if len(new):
            coded = processor(self.model).encode(new.to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint16, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return at.astype(np.int64)

    def coded(self, column: pa.Array) -> pa.Array:
        """The ids of each text as bytes, two an id."""
        if len(self.known) > HELD:
            self.forget()
        column = column.cast(pa.large_string()).fill_null("")
        spare = [pc.match_substring(column, "  "), pc.match_substring(column, "▁"), pc.starts_with(column, " "), pc.ends_with(column, " "), pc.equal(column, "")]
        odd = np.flatnonzero(np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in spare])).tolist()
        words = pc.split_pattern(column, " ")
        each = words.flatten().dictionary_encode()
        place = self.places(each.dictionary)[each.indices.to_numpy()]
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        if odd:
            # Texts with white space to spare are split by the pattern of pre-tokens.
            pieces = [encodable(column[k].as_py()) for k in odd]
            own = pa.array(list(chain.from_iterable(pieces)), pa.large_string()).dictionary_encode()
            own_place = self.places(own.dictionary)[own.indices.to_numpy()]
            own_ends = np.cumsum([len(p) for p in pieces])
            counts = np.diff(bounds)
            runs, at = [], 0
            for k, end, p in zip(odd, own_ends.tolist(), pieces):
                runs += [place[at : bounds[k]], own_place[end - len(p) : end]]
                at = bounds[k + 1]
                counts[k] = len(p)
            place = np.concatenate([*runs, place[at:]])
            bounds = np.concatenate([[0], np.cumsum(counts)])
        sizes = np.diff(self.ends)[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ends[place] - ends[:-1], sizes)
        at += np.arange(len(at))
        return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(2 * ends[bounds]), pa.py_buffer(self.ids[at])])

    def __call__(self, column: pa.Array) -> list[bytes]:
        return self.coded(column).to_pylist()


@lru_cache(maxsize=2)
def coder(model: str) -> Coder:
    """The worker's coder; tasks that run there one after the other share it."""
    return Coder(model)


def sequences(counts: np.ndarray, length: int) -> np.ndarray:
    """Sequences of texts with so many ids: the ids and an end mark, ``length`` at a time."""
    return -(-(counts + 1) // length)


def bodies(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, doc: np.ndarray, seq: np.ndarray, end_mark: int, length: int) -> pa.Array:
    """Sequence ``seq`` of document ``doc``, for each of them, as a binary row of header and ids that count; document k has the ids from ``offsets[k]`` on."""
    start = offsets[doc] + seq * length
    left = offsets[doc + 1] - start
    n, ended = np.minimum(left, length), left < length
    head = HEADER.itemsize // 2
    ends = np.cumsum(head + n + ended)
    begin = ends - (head + n + ended)
    header = np.empty(len(doc), HEADER)
    header["doc_id"], header["seq"], header["n_tokens"] = doc_ids[doc], seq, n + ended
    flat = np.empty(ends[-1], np.uint16)
    flat[begin[:, None] + np.arange(head)] = header.view(np.uint16).reshape(-1, head)
    before, each = np.cumsum(n) - n, np.arange(n.sum())
    flat[np.repeat(begin + head - before, n) + each] = ids[np.repeat(start - before, n) + each]
    flat[(begin + head + n)[ended]] = end_mark
    bounds = np.concatenate([[0], 2 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1 chosen by ``key``, applied to ``index``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, walking = index.astype(np.uint64), np.arange(len(index))
    while len(walking):
        left, right = x[walking] >> np.uint64(half), x[walking] & mask
        for r in range(ROUNDS):
            h = right + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        x[walking] = left << np.uint64(half) | right
        walking = walking[x[walking] >= np.uint64(n)]
    return x.astype(np.int64)


def waves(shards: int) -> list[tuple[int, int]]:
    """The ranges of shards that are written one after the other. The first has seven tenths: its shuffle and shards then take about as much disk as all shards and the shuffle of the rest."""
    cut = -(-7 * shards // 10)
    return [(low, high) for low, high in ((0, cut), (cut, shards)) if low < high]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of a query that has ended, and not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokenised(df: DataFrame, model: str, id_col: str, text: str, length: int) -> DataFrame:
    """(doc_id, ids, part, first): the ids of each document, the task that made them, and the number of its first sequence in that task."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, 6 << 20):
            coded = coder(model).coded(batch.column(1))
            made = sequences(pc.binary_length(coded).to_numpy() // 2, length)
            first = n + np.cumsum(made) - made
            n += int(made.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(-1), coded.cast(pa.binary()), pa.array(np.full(len(first), part, np.int32)), pa.array(first)], ["doc_id", "ids", "part", "first"])

    return df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(code, "doc_id long, ids binary, part int, first long")


def write_training_order(
    df: DataFrame, model: str, path: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int | None = None, key: int = 1
) -> tuple[int, int]:
    """Write the shards under ``path``; returns the number of sequences and the records of a shard (``shard_size`` unless given)."""
    scratch = Scratch(df.sparkSession)
    docs = scratch.stored(tokenised(df, model, id_col, text, length))
    last = F.col("first") + F.ceil((F.length("ids") / 2 + 1) / length)
    # One number per task.
    counts = {r.part: r.n for r in docs.groupBy("part").agg(F.max(last).cast("long").alias("n")).collect()}
    total, parts = sum(counts.values()), sorted(counts)
    shard = shard or shard_size(total)
    places = df.sparkSession.sparkContext.broadcast(dict(zip(parts, np.cumsum([0] + [counts[p] for p in parts]).tolist())))

    shards = -(-total // shard)

    def placed(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            end_mark = processor(model).eos_id()
            for batch in blocks(batches, 2 << 20):
                coded = batch.column(1).cast(pa.large_binary())
                _, offsets, ids = coded.buffers()
                offsets, ids = np.frombuffer(offsets, np.int64)[coded.offset : coded.offset + len(coded) + 1] // 2, np.frombuffer(ids or b"", np.uint16)
                n = sequences(np.diff(offsets), length)
                doc = np.repeat(np.arange(len(n)), n)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = np.array([places.value[p] for p in batch.column(2).to_pylist()], np.int64) + batch.column(3).to_numpy()
                slots = feistel(first[doc] + seq, total, key)
                here = np.flatnonzero((slots >= low * shard) & (slots < high * shard))
                for at in np.split(here, range(4096, len(here), 4096)) if len(here) else []:
                    body = bodies(batch.column(0).to_numpy(), offsets, ids, doc[at], seq[at], end_mark, length)
                    yield pa.RecordBatch.from_arrays([pa.array(slots[at]), pa.array((slots[at] // shard).astype(np.int32)), body], ["slot", "shard", "body"])

        return place

    # The line end is the writer's, so a row carries all bytes but the last.
    whole = F.rpad("body", record(length).itemsize - 1, F.lit(b"\0")).cast("string").alias("value")
    with shuffles_removed(df.sparkSession):
        for low, high in waves(shards):
            made = docs.select("doc_id", "ids", "part", "first").mapInArrow(placed(low, high), "slot long, shard int, body binary")
            ordered = made.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "slot")
            writer = ordered.select(whole, "shard").write.partitionBy("shard").mode("append" if low else "error")
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", high == shards).option("lineSep", "\n").text(path)
    scratch.clear()
    return total, shard


def read_training_order(spark: SparkSession, path: str, length: int, shard: int, first_slot: int = 0) -> DataFrame:
    """(slot, shard, offset, doc_id, seq, n_tokens, crc) of the records from ``first_slot`` on; whole shards before it are not read."""
    kind = record(length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(content.as_buffer(), kind)
                at = np.arange(max(0, first_slot - number * shard), len(rows))
                columns = [number * shard + at, np.full(len(at), number, np.int32), at * kind.itemsize, *(rows[c][at] for c in ("doc_id", "seq", "n_tokens"))]
                crc = [zlib.crc32(rows["ids"][k].tobytes()) for k in at]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(crc, pa.int64())], ["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "crc"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard int").load(path)
    files = files.where(F.col("shard") >= first_slot // shard).select("shard", "content")
    return files.mapInArrow(parse, READ)


READ = "slot long, shard int, offset long, doc_id long, seq int, n_tokens int, crc long"


def resumed(path: str, length: int, shard: int, first_slot: int = 0, at_once: int = 256) -> Iterator[np.ndarray]:
    """Records from ``first_slot`` on in slot order, ``at_once`` of a shard at a time, for a trainer: it seeks and holds no shard."""
    from pyarrow import fs

    kind = record(length)
    store, root = fs.FileSystem.from_uri(path)
    while True:
        number, offset = divmod(first_slot, shard)
        files = store.get_file_info(fs.FileSelector(f"{root}/shard={number}", allow_not_found=True))
        files = [f for f in files if f.base_name.startswith("part-")]
        if not files or offset * kind.itemsize >= files[0].size:
            return
        with store.open_input_file(files[0].path) as file:
            file.seek(offset * kind.itemsize)
            while raw := file.read(at_once * kind.itemsize):
                yield np.frombuffer(raw, kind)
                first_slot += len(raw) // kind.itemsize


def training_order(df: DataFrame, model: str, path: str | None = None, length: int = LENGTH, **options) -> DataFrame:
    """Write the shards (to the shared folder unless ``path`` is given) and read them back, one row per sequence."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    total, shard = write_training_order(df, model, path, length=length, **options)
    return read_training_order(spark, path, length, shard) if total else spark.createDataFrame([], READ)
