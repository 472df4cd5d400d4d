"""The prefix trie of conversations, by an LCP-aware external mergesort.

A conversation becomes one row: its turns' digests in order, 16 bytes each, and their lengths. Blocks of
such rows are sorted into runs; a run is front-coded by the turns that each row shares with the row before it (LCP), cut
into pages, and dealt to ranges of rows. A range reads its pages in the order of their first rows, an order that Spark's
sort keeps on disk, and merges the runs by a loser tree whose matches start behind the turns
known to be shared, so a turn that neighbours share is not compared again. Only pages that
have rows before the next page's first row are held. The merged stream feeds a stack, the open path from the root: a row closes
the nodes deeper than what it shares with its predecessor, and a closed node is finished.

Nodes on the first and the last path of a range may go on in the ranges beside it; they are handed on as parts, twice
the depth of a path for each range, and one pass over the ranges' parts in order, with the same stack, finishes them.
Ranges are bounded by whole rows with their ids, so a conversation or a first turn that very many share is dealt to many
ranges. A node's digest of member ids is one sequential hash, so the ids of one node that spans ranges pass that last task in slices.

Defined results: a null role or text is empty; rows without an id belong to no conversation and are left out; null turns
come first, rows of equal turn are ordered by role and text, repeated rows are turns of their own; a very long text
counts as its digest and length; a conversation is one row of some 24 bytes a turn, so memory follows the longest
one; further columns are not read; an empty table has no root and gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.llm.common import Scratch, partitions_for

#: Bytes of a turn's digest; of rows sorted into one run, on a page, and in a range.
TURN, RUN, PAGE, RANGE = 16, 16 << 20, 128 << 10, 32 << 20
#: Rows whose keys set the bounds of one range, and the bytes of a key that take part.
PER_RANGE, BOUND = 20, 4096
#: Ids handed on in one row, and bytes of pages gathered before they are merged.
IDS, HELD = 50_000, 8 << 20

Row = tuple[bytes, int, bytes]


def placed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, text): turns numbered from 0 in their conversation."""
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def grafted(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Conversations rebuilt on their group's first one: h turns of conversation c - c % ``group``, then c's own turns after
    its first h, where h is the CRC-32 of c in decimal, modulo ``heads``. (conv, place, role, text), place null for the
    one row of a conversation without turns."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    known = turns.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    first = turns.where(F.col("place") < heads - 1).select(F.col("conv").alias("base"), "place", "role", "text")
    grafts = known.join(first, "base").where(F.col("place") < F.col("h")).select("conv", "place", "role", "text")
    own = turns.where(F.col("place") >= h).select("conv", (F.col("place") + heads).alias("place"), "role", "text")
    none = known.select("conv", F.lit(None).cast("int").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))
    return grafts.unionByName(own).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv, key, sizes): a conversation's turn digests in one binary and the UTF-8 bytes of its texts; null places are no turns."""
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * TURN)
    turn = F.when(F.col("place").isNotNull(), F.struct("place", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")))
    rows = turns.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two keys share at their beginning, of which ``known`` are known."""
    most = min(len(a), len(b)) // TURN
    while known < most and a[known * TURN : known * TURN + TURN] == b[known * TURN : known * TURN + TURN]:
        known += 1
    return known


def pages(rows: list[Row], bounds: list[tuple[bytes, int]], run: int) -> Iterator[dict]:
    """A sorted run of ``rows`` (key, conv, sizes) as front-coded pages, none across the bound of a range."""
    rows.sort()
    at = 0
    while at < len(rows):
        range_ = bisect_right(bounds, (rows[at][0][:BOUND], rows[at][1]))
        bound = bounds[range_] if range_ < len(bounds) else None
        page: dict = {"range": range_, "head": rows[at][0], "head_conv": rows[at][1], "run": run, "page": at, "lcps": [], "rests": [], "convs": [], "sizes": []}
        before, size = b"", 0
        while at < len(rows) and size < PAGE and (bound is None or (rows[at][0][:BOUND], rows[at][1]) < bound):
            key, conv, sizes = rows[at]
            lcp = shared(before, key)
            for name, value in (("lcps", lcp), ("rests", key[lcp * TURN :]), ("convs", conv), ("sizes", sizes[lcp * 8 :])):
                page[name].append(value)
            size += len(key) - lcp * TURN + len(sizes) + 64
            before = key
            at += 1
        yield page


PAGES = pa.schema([("range", pa.int32()), ("head", pa.binary()), ("head_conv", pa.int64()), ("run", pa.int64()), ("page", pa.int32()), ("lcps", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("convs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.binary()))])


class Cursor:
    """A run's rows that a range has read so far: the head, and the turns it shares with the row before it in the run."""

    def __init__(self):
        self.held: list[tuple[Row, int]] = []
        self.at = 0

    def add(self, page: dict) -> int:
        """Decode a page behind what is held; its bytes."""
        self.held, self.at = self.held[self.at :], 0
        key, sizes, total = b"", b"", 0
        for k, (lcp, rest, conv, more) in enumerate(zip(page["lcps"], page["rests"], page["convs"], page["sizes"])):
            key, sizes = key[: lcp * TURN] + rest, sizes[: lcp * 8] + more
            if not k and self.held:
                lcp = shared(self.held[-1][0][0], key)
            self.held.append(((key, conv, sizes), lcp))
            total += len(key) + len(sizes) + 150
        return total

    def head(self, stop: tuple[bytes, int] | None) -> Row | None:
        row = self.held[self.at][0] if self.at < len(self.held) else None
        return None if row is None or (stop is not None and row[:2] >= stop) else row


def merged(cursors: list[Cursor], last: bytes, stop: tuple[bytes, int] | None) -> Iterator[tuple[Row, int]]:
    """The rows of sorted runs before ``stop`` in order, each with the turns it shares with the one before it
    (the first with ``last``): a loser tree whose matches start where both sides are known to agree with the last winner."""
    n = len(cursors)
    heads = [c.head(stop) for c in cursors]
    lcps = [shared(last, h[0]) if h else 0 for h in heads]

    def match(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two heads; what the loser shares with the winner is kept for its next match."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if lcps[i] != lcps[j]:
            return (i, j) if lcps[i] > lcps[j] else (j, i)
        same = shared(a[0], b[0], lcps[i])
        at = same * TURN
        mine, other = a[0][at : at + TURN], b[0][at : at + TURN]
        first, second = (i, j) if (mine, a[1]) < (other, b[1]) else (j, i)
        lcps[second] = same
        return first, second

    winners, losers = [0] * n + list(range(n)), [0] * n
    for k in range(n - 1, 0, -1):
        winners[k], losers[k] = match(winners[2 * k], winners[2 * k + 1])
    best = winners[1] if n > 1 else 0
    while n and heads[best] is not None:
        yield heads[best], lcps[best]
        own = cursors[best]
        own.at += 1
        heads[best] = own.head(stop)
        lcps[best] = own.held[own.at][1] if heads[best] else 0
        k = (n + best) // 2
        while k:
            best, losers[k] = match(losers[k], best)
            k //= 2


def forecast(rows: Iterable[dict]) -> Iterator[tuple[Row, int]]:
    """Merge pages that come in the order of their first rows: what stands before the next page's first row is final."""
    cursors: dict[int, Cursor] = {}
    held, last = 0, b""
    for page in rows:
        if held > HELD:
            for row, lcp in merged(list(cursors.values()), last, (page["head"], page["head_conv"])):
                yield row, lcp
                last = row[0]
            cursors = {run: c for run, c in cursors.items() if c.at < len(c.held)}
            held = sum((len(k) + len(s) + 150) for c in cursors.values() for (k, _, s), _ in c.held[c.at :])
        held += cursors.setdefault(page["run"], Cursor()).add(page)
    yield from merged(list(cursors.values()), last, None)


class Node:
    """An open node; sums are those of its finished children and of the rows that end at it."""

    __slots__ = ("id", "parent", "depth", "size", "least", "convs", "children", "leaves", "saved", "ends", "hash")

    def __init__(self, id_: bytes, parent: bytes | None, depth: int, size: int):
        self.id, self.parent, self.depth, self.size = id_, parent, depth, size
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.hash = array("q"), None

    def low(self, conv: int | None) -> None:
        if conv is not None:
            self.least = conv if self.least is None else min(self.least, conv)

    def hashed(self) -> None:
        """Move the ids of ``ends`` into the running hash."""
        if self.ends:
            text = ",".join(map(str, self.ends))
            if self.hash is None:
                self.hash = hashlib.sha256()
            else:
                text = "," + text
            self.hash.update(text.encode())
            self.ends = array("q")

    def finish(self, above: Node | None) -> dict:
        """The node's row; its sums go to the open node above it."""
        self.hashed()
        saved = self.saved + (self.convs - 1) * self.size
        leaves = self.leaves or 1
        if above:
            above.low(self.least)
            above.convs += self.convs
            above.children += 1
            above.leaves += leaves
            above.saved += saved
        digest = (self.hash or hashlib.sha256()).hexdigest()
        return self.row() | {"leaves": leaves, "saved": saved, "ends_sha256": digest}

    def row(self) -> dict:
        return {"id": self.id, "parent": self.parent, "depth": self.depth, "size": self.size, "least": self.least, "convs": self.convs, "children": self.children, "leaves": self.leaves, "saved": self.saved}


def child(above: Node | None, turn: bytes, size: int) -> Node:
    if above is None:
        return Node(b"", None, 0, 0)
    return Node(hashlib.sha256(above.id + turn).digest()[:TURN], above.id, above.depth + 1, size)


def nodes(stream: Iterable[tuple[Row, int]], range_: int) -> Iterator[dict]:
    """Finished nodes of a sorted stream, then the parts of those on its first and last path, from the root down the first path and then the rest of the last."""
    path: list[Node] = []
    first, closed = -1, []
    for (key, conv, sizes), lcp in stream:
        if not path:
            path.append(child(None, b"", 0))
            first, lcp = len(key) // TURN, 0
        else:
            while len(path) - 1 > lcp:
                node = path.pop()
                if node.depth <= first:
                    closed.append(node)
                else:
                    yield node.finish(path[-1])
            first = min(first, lcp)
        own = memoryview(sizes).cast("q")
        for depth in range(lcp, len(key) // TURN):
            path.append(child(path[-1], key[depth * TURN : depth * TURN + TURN], own[depth]))
        path[-1].ends.append(conv)
        path[-1].convs += 1
        path[-1].low(conv)
    parts = [n for n in path if n.depth <= first] + closed[::-1] + [n for n in path if n.depth > first]
    turn = 0
    for node in parts:
        for at in range(0, max(1, len(node.ends)), IDS):
            whole = node if not at else Node(node.id, node.parent, node.depth, node.size)
            yield whole.row() | {"range": range_, "turn": turn, "ends": node.ends[at : at + IDS].tolist()}
            turn += 1


def joined(parts: Iterable[dict]) -> Iterator[dict]:
    """Finished nodes of all ranges' parts, which come in the order of the ranges."""
    path: list[Node] = []
    for part in parts:
        depth = part["depth"]
        if depth >= len(path) or path[depth].id != part["id"]:
            while len(path) > depth:
                node = path.pop()
                yield node.finish(path[-1] if path else None)
            path.append(Node(part["id"], part["parent"], depth, part["size"]))
        node = path[depth]
        node.low(part["least"])
        node.convs += part["convs"]
        node.children += part["children"]
        node.leaves += part["leaves"]
        node.saved += part["saved"]
        node.ends.extend(part["ends"])
        node.hashed()
    while path:
        node = path.pop()
        yield node.finish(path[-1] if path else None)


NODE = "id binary, parent binary, depth long, size long, least long, convs long, children long, leaves long, saved long, ends_sha256 string, range int, turn int, ends array<long>"
_NODES = pa.schema(
    [("id", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "size", "least", "convs", "children", "leaves", "saved")), ("ends_sha256", pa.string()), ("range", pa.int32()), ("turn", pa.int32()), ("ends", pa.list_(pa.int64()))]
)


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``turns`` (conv, place, role, text), as ``placed`` and ``grafted`` make them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member
    of the node and of its parent; members; children; leaves below; over the subtree, bytes of the last turn's text for each member
    but one; the digest of the ids of those that end here.
    """
    scratch = Scratch(turns.sparkSession)
    rows = scratch.stored(sequences(turns))
    total = rows.agg(F.sum(F.length("key") + 8 * F.size("sizes") + 64)).first()[0] or 0
    ranges = max(partitions_for(turns), -(-total // RANGE))
    some = rows.orderBy(F.xxhash64("conv"), "conv").limit(PER_RANGE * ranges).select(F.substring("key", 1, BOUND).alias("key"), "conv").collect()
    keys = sorted((bytes(r.key), r.conv) for r in some)
    bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32

        def cut() -> Iterator[dict]:
            nonlocal run
            held, size = [], 0
            for row in _rows(batches):
                held.append((row["key"], row["conv"], array("q", row["sizes"]).tobytes()))
                size += len(row["key"]) + len(held[-1][2]) + 150
                if size >= RUN:
                    yield from pages(held, bounds, run)
                    held, size, run = [], 0, run + 1
            yield from pages(held, bounds, run)

        return _batches(cut(), PAGES, 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(nodes(forecast(_rows(batches)), TaskContext.get().partitionId()), _NODES, 1000)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(joined(_rows(batches)), _NODES, 1000)

    schema = "range int, head binary, head_conv long, run long, page int, lcps array<int>, rests array<binary>, convs array<long>, sizes array<binary>"
    dealt = rows.select("conv", "key", "sizes").mapInArrow(runs, schema).repartitionById(len(bounds) + 1, "range")
    found = scratch.stored(dealt.sortWithinPartitions("head", "head_conv", "run", "page").mapInArrow(merge, NODE))
    edges = scratch.stored(found.where("range is not null").repartition(1).sortWithinPartitions("range", "turn").mapInArrow(join, NODE))
    every = found.where("range is null").unionByName(edges)
    above = every.where("children > 0").select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    names = {"conv_id": "least", "depth": "depth", "parent_conv_id": "parent_conv_id", "n_convs": "convs", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved", "ends_sha256": "ends_sha256"}
    return every.join(above, "parent", "left").select(*[F.col(c).alias(name) for name, c in names.items()])
