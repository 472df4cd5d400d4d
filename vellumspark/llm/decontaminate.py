"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, a scan of the documents.

Benchmark items become windows of ``width`` words (an item of fewer words is one window). Their
64-bit hashes are broadcast with the windows' words; each task hashes the windows of its documents
in numpy, looks them up, and compares the words of every hit, so equal hashes alone decide nothing.
Documents are never shuffled: a hot source, a passage that a third of them share or a very long text
are scanned where they are read, and a task holds one block of text.

What is broadcast is cut into blocks of at most ``block_bytes``, by a hash of window and item. One
block is the usual case; a benchmark of more is scanned block after block, each pass written to the
shared folder and handing on what the passes before have found. Nothing is capped.

Defined results: null and empty texts, and items without words, have no words and hit nothing;
a very long text is scanned whole; repeated documents are judged one by one, repeated items
count once; items that share a window are all named; hits of an item without an id
count as hits but name no item; a window never crosses a document's end; the columns of the documents
stand in the struct ``row``, so their names clash with nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.bytewords import Words, find_words, text_bytes
from vellumspark.llm.common import Scratch, blocks

#: Words of a window.
WIDTH = 10
#: Bytes of windows and item ids in one broadcast block.
BLOCK = 16 << 20
#: Bytes of document text scanned together, and of words hashed together.
TEXT, CHUNK = 2 << 20, 1 << 20

#: Bytes that belong to words, once A-Z are lowered: digits, a to z, all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_ODD = np.random.default_rng(13).integers(1, 1 << 63, (3, 1024), np.uint64) * 2 + 1
_BYTE = np.where(_WORD, np.random.default_rng(14).integers(1, 1 << 63, 256, np.uint64), 0).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, some ``CHUNK`` bytes at a time; equal words have equal hashes."""
    out = np.empty(len(words.starts), np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(words.ends, words.starts[at] + CHUNK, "right")))
        low, starts, ends = words.starts[at], words.starts[at:to], words.ends[at:to]
        place = np.arange(low, ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
        terms = _BYTE[words.data[low : ends[-1]]] * _ODD[0][place & 1023]
        out[at:to] = _mixed(np.add.reduceat(terms, starts - low) + (ends - starts).astype(np.uint64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring words, wherever texts end; the last few places have none."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, _ODD[2][width & 1023])
    for k in range(width):
        out += hashes[k : k + n] * _ODD[1][k & 1023]
    return _mixed(out)


def _text(data: bytes, words: Words, at: int, width: int) -> bytes:
    return b" ".join([data[words.starts[k] : words.ends[k]] for k in range(at, at + width)])


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(hash, width, words, item) of every distinct window of every item; ``item`` is its id as a string, perhaps null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, TEXT):
            words = find_words(*text_bytes(batch.column(1)), _WORD)
            hashes, data, ids = word_hashes(words), words.data.tobytes(), batch.column(0).to_pylist()
            rows: dict[str, list] = {"hash": [], "width": [], "words": [], "item": []}
            for d, item in enumerate(ids):
                first, last = int(words.first[d]), int(words.first[d + 1])
                size = min(width, last - first)
                found = window_hashes(hashes[first:last], size).astype(np.int64).tolist() if size else []
                rows["hash"] += found
                rows["width"] += [size] * len(found)
                rows["words"] += [_text(data, words, first + k, size) for k in range(len(found))]
                rows["item"] += [item] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows["hash"], pa.int64()), pa.array(rows["width"], pa.int32()), pa.array(rows["words"], pa.binary()), pa.array(rows["item"], pa.string())], list(rows))

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "hash long, width int, words binary, item string").distinct()


class HashSet:
    """A block of windows to look up: sorted hashes, a bitmap before them, words and items of each."""

    def __init__(self, rows: pa.Table):
        keys: dict[tuple[int, bytes], list[str]] = {}
        self.widths = sorted(set(rows["width"].to_pylist()))
        for h, words, item in zip(rows["hash"].to_pylist(), rows["words"].to_pylist(), rows["item"].to_pylist()):
            keys.setdefault((h % (1 << 64), words), []).append(item)
        ordered = sorted(keys)
        self.hashes = np.array([h for h, _ in ordered], np.uint64)
        self.words = [w for _, w in ordered]
        self.items = [[x for x in keys[k] if x is not None] for k in ordered]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[self.hashes >> np.uint64(44)] = True

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(place of the first word, width, items) of every window of the texts that is in the set, its words compared."""
        data = None
        for width in self.widths:
            found = window_hashes(hashes, width)
            near = np.flatnonzero(self.flags[found >> np.uint64(44)])
            low = np.searchsorted(self.hashes, found[near])
            same = low < len(self.hashes)
            same[same] = self.hashes[low[same]] == found[near[same]]
            near, low = near[same], low[same]
            text = np.searchsorted(words.first, near, "right") - 1
            whole = near + width <= words.first[text + 1]
            for at, k in zip(near[whole].tolist(), low[whole].tolist()):
                data = words.data.tobytes() if data is None else data
                own, h = _text(data, words, at, width), self.hashes[k]
                while k < len(self.words) and self.hashes[k] == h:
                    if self.words[k] == own:
                        yield at, width, self.items[k]
                        break
                    k += 1


def _joined(before: list | None, size: int, own: np.ndarray) -> np.ndarray:
    """Which of a document's words are hit: by this pass (``own``, counts) or the passes before (flat word intervals)."""
    hit = own > 0
    for a, b in zip((before or [])[::2], (before or [])[1::2]):
        hit[a:b] = True
    return hit


FOUND = "n_words long, n_hit long, items array<string>, hit_words array<int>, spans array<struct<start:long,end:long>>, clean string"


def _scanned(df: DataFrame, rows: pa.Table, final: bool) -> DataFrame:
    """One pass: ``df`` (row, text, hit_words, items) with what the windows ``rows`` hit besides; the last one drops the text."""
    held = df.sparkSession.sparkContext.broadcast(HashSet(rows))
    row = df.schema["row"].dataType.simpleString()
    text = "" if final else "text string, "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = held.value
        for batch in blocks(batches, TEXT):
            raw, offsets = text_bytes(batch.column(1))
            words = find_words(raw, offsets, _WORD)
            marks, named = np.zeros(len(words.starts) + 1, np.int64), {}
            for at, width, items in looked.hits(words, word_hashes(words)):
                marks[at] += 1
                marks[at + width] -= 1
                named.setdefault(int(np.searchsorted(words.first, at, "right")) - 1, set()).update(items)
            depth = np.cumsum(marks)[:-1]
            hit_before, items_before = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple] = []
            for d in range(batch.num_rows):
                first, last = int(words.first[d]), int(words.first[d + 1])
                hit = _joined(hit_before[d], last - first, depth[first:last])
                if not hit.any():
                    out.append((last - first, 0, [], [], [], None))
                    continue
                edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                begin, low = int(offsets[d]), raw[offsets[d] : offsets[d + 1]]
                spans = [(int(words.starts[first + a]) - begin, int(words.ends[first + b - 1]) - begin) for a, b in zip(edges[::2], edges[1::2])]
                points = np.append(0, np.cumsum((low & 0xC0) != 0x80))
                parts = [low[a:b].tobytes() for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(low)])]
                items = sorted({*(items_before[d] or []), *named.get(d, ())}, key=lambda x: x.encode())
                out.append((last - first, int(hit.sum()), items, edges.tolist(), [{"start": int(points[a]), "end": int(points[b])} for a, b in spans], b"".join(parts).decode()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            found = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            names = ["n_words", "n_hit", "items", "hit_words", "spans", "clean"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 if final else 2], *found], [*["row", "text"][: 1 if final else 2], *names])

    return df.select("row", "text", "hit_words", "items").mapInArrow(run, f"row {row}, {text}{FOUND}")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (its columns, or those of ``carry``), ``n_words``, ``n_hit`` (words inside windows of the
    benchmark), ``items`` (ids of the items whose windows occur, as sorted strings), ``hit_words`` (word
    intervals, flat), ``spans`` (runs of hit words, in code points) and ``clean`` (the text without the spans; null where nothing is hit)."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.stored(item_windows(items, item_id, item_text, width))
    total = windows.agg(F.sum(F.length("words") + F.coalesce(F.length("item"), F.lit(0)) + 32)).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("hash", "item"), F.lit(passes))
    found = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(text).alias("text"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    for k in range(passes):
        found = _scanned(found, windows.where(block == k).toArrow(), k == passes - 1)
        if k < passes - 1:
            found = Scratch(docs.sparkSession).stored(found)
    scratch.clear()
    return found


def without_documents(docs: DataFrame, items: DataFrame, most: float = 0.0, **options) -> DataFrame:
    """The documents of which at most a share ``most`` of the words is hit, with their own columns."""
    return contamination(docs, items, **options).where(F.col("n_hit") <= most * F.col("n_words")).select("row.*")


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, the hit spans cut out of their texts; null texts stay null."""
    found = contamination(docs, items, text=text, **options)
    own = lambda c: F.col("row").getField(c)
    return found.select(*[(F.coalesce("clean", own(c)) if c == text else own(c)).alias(c) for c in docs.columns])
