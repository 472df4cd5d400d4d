"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Documents with equal shingle sets form a class; its smallest document stands for it. All
shingles stand in one global order: the rest by fingerprint, then those found often in some
block of documents, the rarer first. Fingerprint ranges and the frequent end cut this order into
fragments. A fragment of a set is a row of its own; for each pair of candidates the overlap is
counted in each fragment separately, by whichever task the fragment is dealt to, and the partial
counts are summed per pair.

Candidates come from prefixes: a pair above the threshold shares a shingle among the first few
of both. Prefix shingles are dealt by shingle, sorted inside their partition (which spills) and
read as a stream, so no group is held. A shingle shared by more than a few classes does not
pair them: shingles with the same class of least hash, which those of one passage or group of
near copies mostly have, make one group of classes, so that a pair meets once and not once per
shingle. The classes of a group are linked to a few hubs; once those links are verified and
contracted, only classes outside a group's main component meet the others of about their size, in
blocks bounded in rows and bytes, the nearest ones first. A pair inside a component changes no
component, so nothing is lost and no cap is needed. A shingle that is known to be very frequent
is salted from the start, and so are the joins of a group with its hubs.

Fingerprints have 64 bits; two different shingles are taken for equal with probability 2**-64.

Defined results: null or empty texts have no shingles and are linked with nothing; repeated rows
share a class, and of classes in one component the smallest id names it, so ties cannot arise;
very long texts are cut at fragments and blocks of their own; rows with a null id take part in no
class and have a null component; further columns, whatever their names, are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import Scratch
from vellumspark.llm.components import connected_components
from vellumspark.llm.shingles import U, bits_apart, digests, folded, mixed, shingled, sketches

#: Most shingles that are put last in the order (they are broadcast, eight bytes each).
FREQUENT = 1 << 18
#: A shingle is put last if this many documents of a block, and of all blocks' finds, have it.
IN_BLOCK, IN_ALL = 3, 30
#: Fingerprints in a block in which frequent shingles are counted.
COUNTED = 4 << 20
#: Classes that share a prefix shingle and are paired directly; beyond, by hubs and blocks.
DIRECT = 16
HUBS = 3
#: Tasks among which the classes of a group are dealt to meet its hubs.
SPREAD = 16
#: Rows and bytes of a block of classes that meet another block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Finds of a frequent shingle for each of its salts.
SALTED = 1 << 14
#: Pairs held before repeated ones are removed and the rest is passed on.
HELD = 1 << 18
#: Fragments in which overlaps are counted: ranges of fingerprints, and the frequent end.
FRAGMENTS = 4
#: Classes whose ids are broadcast to find their texts (24 bytes each); beyond, a shuffled join.
BROADCAST_IDS = 1 << 19


class Threshold(NamedTuple):
    """A Jaccard similarity of ``num / den`` or more."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def sizes_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def links(self, shared, total):
        """Whether sets of ``total`` elements together are linked by ``shared`` common ones."""
        return self.den * shared >= self.num * (total - shared)

    def band(self, n, shift: float = 0.0):
        """Sizes that fit lie in the same band or in neighbouring ones."""
        return F.floor(F.log(n) / math.log(self.den / self.num) + shift).cast("int")

    def differ_fit(self, differ, total):
        """Whether sets of ``total`` elements together may differ in ``differ`` ones."""
        return (self.den + self.num) * differ <= (self.den - self.num) * total


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def profiles(df: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """One row per document (id, n, d1, d2, sketch) and one per find of a frequent shingle (d1, found)."""
    schema = "id long, n long, d1 long, d2 long, sketch binary, found long"
    names = [f.split()[0] for f in schema.split(", ")]

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values, counts = values[counts >= IN_BLOCK], counts[counts >= IN_BLOCK]
        none = pa.nulls(len(values), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(values.view(np.int64)), none, pa.nulls(len(values), pa.binary()), pa.array(counts.astype(np.int64))], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for block, h, sizes in shingled(batches, width):
            d1, d2 = digests(h, sizes)
            columns = [block.column(0).cast(pa.int64()), *(pa.array(x.view(np.int64)) for x in (sizes, d1, d2)), sketches(h, sizes)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sizes), pa.int64())], names)
            new = np.array([not (x in seen or seen.add(x)) for x in d1.tolist()], bool)
            held.append(h[np.repeat(new, sizes)])
            size += len(held[-1])
            if size >= COUNTED:
                yield from frequent(held)
                held, size, seen = [], 0, set()
        if size:
            yield from frequent(held)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(scan, schema)


class Order:
    """The global order: by fingerprint, but the broadcast frequent shingles last, the rarer first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, salts: np.ndarray):
        by_value = np.argsort(frequent)
        self.frequent = frequent[by_value]
        self.rank = np.empty(len(frequent), np.int64)
        self.rank[np.lexsort((self.frequent, counts[by_value]))] = np.arange(len(frequent))
        self.salts = salts[by_value]
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self.frequent >> U(40)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each shingle among the frequent ones, -1 for others."""
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.maybe[h >> U(40)])
        if len(at):
            place = np.minimum(np.searchsorted(self.frequent, h[at]), len(self.frequent) - 1)
            out[at] = np.where(self.frequent[place] == h[at], place, -1)
        return out

    def prefixes(self, place: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """A mask of the first ``wanted`` shingles of each set; ``place`` as of ``places``."""
        late = place >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        early = np.concatenate([[0], np.cumsum(~late)])
        n_early = early[first + sizes] - early[first]
        rank = early[:-1] - early[first][owner]
        at = np.flatnonzero(late)
        at = at[np.lexsort((self.rank[place[at]], owner[at]))]
        n_late = np.bincount(owner[at], minlength=len(sizes))
        rank[at] = np.arange(len(at)) - (np.cumsum(n_late) - n_late)[owner[at]] + n_early[owner[at]]
        return rank < wanted[owner]


def postings(df: DataFrame, text: str, width: int, least: Threshold, frequent) -> DataFrame:
    """(h, salt, d, n): the prefix shingles of each set with its digest and size; only those of very frequent ones have a salt."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*frequent.value)
        for _, h, sizes in shingled(batches, width):
            d1, _ = digests(h, sizes)
            _, first = np.unique(d1, return_index=True)
            chosen = np.zeros(len(sizes), bool)
            chosen[first] = True
            place = order.places(h)
            mask = order.prefixes(place, sizes, np.where(chosen & (sizes > 0), least.prefix(sizes), 0))
            h, place, d, n = h[mask], place[mask], np.repeat(d1, sizes)[mask], np.repeat(sizes, sizes)[mask]
            salt = np.zeros(len(h), np.int32)
            hot = np.flatnonzero(place >= 0)
            salts = order.salts[place[hot]]
            salt[hot] = np.where(salts > 1, 1 + (d[hot] % salts.astype(np.uint64)).astype(np.int64), 0)
            columns = [pa.array(h.view(np.int64)), pa.array(salt), pa.array(d.view(np.int64)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "salt", "d", "n"])

    return df.select(F.lit(0), F.col(text)).mapInArrow(scan, "h long, salt int, d long, n int")


def distinct_pairs(held: list[np.ndarray]) -> np.ndarray:
    """The distinct columns of two-row arrays."""
    pairs = np.concatenate(held, axis=1) if held else np.empty((2, 0), np.int64)
    pairs = pairs[:, np.lexsort(pairs)]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, new]


def met(posted: DataFrame, least: Threshold, direct: int) -> DataFrame:
    """Pairs of digests (a, b) that share a prefix shingle, and (a, token, salt, n) of the members of those too frequent to pair.

    Read as a stream sorted by shingle: at most one unfinished shingle of ``direct`` classes is held.
    """
    names = ["a", "b", "token", "salt", "n"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32)]
        # The shingle, and the last class of it, that is being passed on as frequent.
        large_h, large_d = None, None
        held, size = [], 0
        for last, batch in ended(batches):
            h, salt, d, n = ([*rest] if batch is None else [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns)])
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            if large_h is not None and len(h):
                new[0] = h[0] != large_h or d[0] != large_d
            h, salt, d, n = (x[new] for x in (h, salt, d, n))
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            sizes = np.diff(np.append(start, len(h)))
            many = (sizes > direct) | (salt[start] > 0)
            if len(h) and large_h is not None:
                many[0] |= h[0] == large_h
            whole = len(h)
            if not last and len(h) and not many[-1]:
                whole = start[-1]
            if len(h) and many[-1]:
                large_h, large_d = h[-1], d[-1]
            each, gone = np.repeat(sizes, sizes)[:whole], np.repeat(many, sizes)[:whole]
            near = np.flatnonzero((each > 1) & ~gone)
            for k in range(1, direct):
                near = near[near + k < whole]
                near = near[h[near] == h[near + k]]
                if not len(near):
                    break
                fit = near[least.sizes_fit(n[near].astype(np.int64), n[near + k].astype(np.int64))]
                held.append(np.stack([d[fit], d[fit + k]]))
                size += len(fit)
            at = np.flatnonzero(gone)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.nulls(len(at), pa.int64()), pa.array(h[at]), pa.array(salt[at]), pa.array(n[at])], names)
            if size >= HELD or last:
                a, b = distinct_pairs(held)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32()))], names)
                held, size = [], 0
            rest = [x[whole:] for x in (h, salt, d, n)]

    dealt = posted.repartition("h", "salt").sortWithinPartitions("h", "d")
    return dealt.mapInArrow(meet, "a long, b long, token long, salt int, n int")


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """Every batch, then once (True, None)."""
    for batch in batches:
        yield False, batch
    yield True, None


def groups(large: DataFrame) -> DataFrame:
    """(grouped, a, n): the members of each frequent shingle, in one group with those of other shingles of the same least member."""
    least = large.groupBy("token").agg(F.min_by("a", F.xxhash64("a")).alias("grouped"))
    # A salted shingle's members stand in several tasks, each with a copy of its group's name.
    least = large.select("token", "salt").distinct().join(least, "token")
    return large.join(least, ["token", "salt"]).select("grouped", "a", "n").distinct()


def hub_pairs(members: DataFrame, least: Threshold) -> DataFrame:
    """Pairs (a, b) of each class and the hubs of its group and size: those of least salted hash."""
    out = []
    for seed in range(HUBS):
        rows = members.withColumn("level", least.band("n", seed / HUBS))
        hubs = rows.groupBy("grouped", "level").agg(F.min_by(F.struct("a", "n"), F.xxhash64("a", F.lit(seed + 1))).alias("hub"))
        hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("a", F.lit(-1)), F.lit(SPREAD)).cast("int")).join(hubs, ["grouped", "level", "salt"])
        fit = least.den * F.least("n", "hub.n") >= least.num * F.greatest("n", "hub.n")
        out.append(met.where((F.col("a") != F.col("hub.a")) & fit).select("a", F.col("hub.a").alias("b")))
    return reduce(DataFrame.unionByName, out)


def candidates(pairs: DataFrame, classes: DataFrame, least: Threshold) -> DataFrame:
    """Pairs of classes (a, b, na, nb) that the size and sketch bounds leave; a is the smaller id."""
    x, y = (classes.select(*(F.col(c).alias(f"{c}_{k}") for c in ("d1", "cid", "n", "sketch"))) for k in "xy")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(x, F.col("d1_x") == F.col("a")).join(y, F.col("d1_y") == F.col("b"))
    both = both.where((least.den * F.least("n_x", "n_y") >= least.num * F.greatest("n_x", "n_y")) & (F.col("cid_x") != F.col("cid_y")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = np.array([bits_apart(s, t) for s, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(least.differ_fit(differ, n)))

    first = F.col("cid_x") < F.col("cid_y")
    ends = [F.least("cid_x", "cid_y"), F.greatest("cid_x", "cid_y"), F.when(first, F.col("n_x")).otherwise(F.col("n_y")), F.when(first, F.col("n_y")).otherwise(F.col("n_x"))]
    named = (c.alias(k) for c, k in zip(ends, ("a", "b", "na", "nb")))
    return both.select(*named, "sketch_x", "sketch_y").mapInArrow(near, "a long, b long, na long, nb long").distinct()


class Verifier:
    """Counts overlaps of pairs of classes; fragments of a set are cut when a pair first needs them, and kept."""

    def __init__(self, df: DataFrame, classes: DataFrame, id_col: str, text: str, width: int, least: Threshold, frequent, scratch: Scratch):
        self.docs = df.select(F.col(id_col).cast("long").alias("cid"), F.col(text).alias("text"))
        self.classes, self.width, self.least, self.frequent, self.scratch = classes, width, least, frequent, scratch
        self.had: DataFrame | None = None
        self.fragments: DataFrame | None = None

    def cut(self, pairs: DataFrame) -> None:
        ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        ids = self.scratch.stored(ids.join(self.had, "cid", "left_anti") if self.had else ids)
        n = ids.count()
        if self.had and not n:
            return
        wanted = ids.join(self.classes.select("cid", "d1", "d2"), "cid")
        docs = self.docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "cid").select("cid", "text", "d1", "d2")
        new = self.scratch.stored(cut(docs, self.width, self.frequent).dropDuplicates(["cid", "fragment"]))
        self.had = self.had.unionByName(ids) if self.had else ids
        self.fragments = self.fragments.unionByName(new) if self.fragments else new

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of the stored pairs (a, b, na, nb) those that reach the threshold: partial overlaps per fragment, summed per pair."""
        self.cut(pairs)
        each = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(k) for k in range(FRAGMENTS)))))
        sides = each.join(self.fragments.select(F.col("cid").alias("a"), "fragment", F.col("part").alias("x")), ["a", "fragment"])
        sides = sides.join(self.fragments.select(F.col("cid").alias("b"), "fragment", F.col("part").alias("y")), ["b", "fragment"])

        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [shared(x, y) for x, y in zip(batch.column(3), batch.column(4))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], ["a", "b", "total", "n"])

        partial = sides.select("a", "b", F.col("na") + F.col("nb"), "x", "y").mapInArrow(overlap, "a long, b long, total long, n long")
        summed = partial.groupBy("a", "b", "total").agg(F.sum("n").alias("n"))
        return summed.where(self.least.links(F.col("n"), F.col("total"))).select("a", "b")


def cut(docs: DataFrame, width: int, frequent) -> DataFrame:
    """(cid, fragment, part) of the rows (cid, text, d1, d2) whose text has the digests: each set's shingles by fragment, ascending."""
    edges = np.array([(k << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*frequent.value)
        for block, h, sizes in shingled(batches, width):
            d1, d2 = digests(h, sizes)
            own = (d1.view(np.int64) == block.column(2).to_numpy()) & (d2.view(np.int64) == block.column(3).to_numpy())
            keep = np.repeat(own, sizes)
            h, doc = h[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
            which = np.where(order.places(h) >= 0, FRAGMENTS - 1, np.searchsorted(edges, h, side="right"))
            by = np.lexsort((h, which, doc))
            h, key = h[by], (doc * FRAGMENTS + which)[by]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(h) else np.empty(0, np.int64)
            offsets = 8 * np.append(start, len(h))
            parts = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])
            cids = block.column(0).cast(pa.int64()).to_numpy()[key[start] // FRAGMENTS]
            yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array((key[start] % FRAGMENTS).astype(np.int32)), parts], ["cid", "fragment", "part"])

    return docs.mapInArrow(run, "cid long, fragment int, part binary")


def shared(x: pa.BinaryScalar, y: pa.BinaryScalar) -> int:
    """Elements that two ascending fragments have in common."""
    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def across(members: DataFrame, classes: DataFrame, labels: DataFrame, least: Threshold, block: int, nearest: bool, scratch: Scratch) -> DataFrame:
    """Pairs of digests (a, b) of a group, from different components, whose sketches are near.

    A group whose classes are one component is done. Of any other, each class outside its main
    component meets the classes of its own and the neighbouring size bands: blocks of those
    outside by blocks of all, so what is sent and compared grows with the number outside.
    ``nearest``: only the nearest class of each one outside and block; a first pass over these
    contracts most of what a pass over all would pair.
    """
    rows = members.select("grouped", "a").join(classes.select(F.col("d1").alias("a"), "cid", "n"), "a").join(labels, F.col("cid") == F.col("member"), "left")
    rows = rows.select("grouped", "cid", "n", F.coalesce("component", "cid").alias("component"))
    sizes = rows.groupBy("grouped", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("grouped").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(main.select("grouped", "main"), "grouped").join(classes.select("cid", "d1", "sketch"), "cid")
    rows = scratch.stored(rows.select("grouped", "cid", "d1", "n", "component", "sketch", (F.col("component") != F.col("main")).alias("outside"), least.band("n").alias("band")))
    outside = rows.where("outside").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))

    def blocks_of(side: DataFrame, name: str) -> DataFrame:
        by_size = (F.count("*") / block + F.sum(F.length("sketch") + 64) / BLOCK_BYTES).cast("int") + 1
        return side.groupBy("grouped", "band").agg(by_size.alias(name))

    grid = scratch.stored(blocks_of(outside, "n_i").join(blocks_of(rows, "n_j"), ["grouped", "band"]))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["grouped", "band", "d1", "n", "component", "sketch"]
    us = outside.join(grid, ["grouped", "band"]).select(*kept, own("n_i").alias("i"), every("n_j").alias("j"), F.lit(True).alias("us"))
    them = rows.join(grid, ["grouped", "band"]).select(*kept, own("n_j").alias("j"), every("n_i").alias("i"), F.lit(False).alias("us"))

    def compare(group: pa.Table) -> pa.Table:
        d, n, component, us = (group[name].to_numpy() for name in ("d1", "n", "component", "us"))
        sketch = group["sketch"].to_pylist()
        length = np.array([len(x) for x in sketch])
        out = []
        # Sizes that fit have sketches of the same length or of twice it, and those are compared at the shorter one.
        for short in np.unique(length).tolist():
            like = np.flatnonzero((length == short) | (length == 2 * short))
            bits = np.stack([folded(sketch[k], short) for k in like])
            exact = length[like] == short
            left, right = np.flatnonzero(us[like]), np.flatnonzero(~us[like])
            step = max(1, (4 << 20) // short)
            for i in left.tolist():
                x = like[i]
                fit = (exact[i] | exact[right]) & (component[x] != component[like[right]]) & least.sizes_fit(n[x], n[like[right]])
                others = right[fit]
                found = []
                for k in range(0, len(others), step):
                    some = others[k : k + step]
                    differ = np.bitwise_count(bits[i] ^ bits[some]).sum(axis=1, dtype=np.int64)
                    near = least.differ_fit(differ, n[x] + n[like[some]])
                    found.append(np.stack([np.full(near.sum(), x), like[some[near]], differ[near]]))
                found = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
                if nearest and found.shape[1]:
                    found = found[:, np.lexsort((d[found[1]], found[2]))[:1]]
                out.append(found)
        x, y, _ = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
        a, b = distinct_pairs([np.stack([np.minimum(d[x], d[y]), np.maximum(d[x], d[y])])])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return us.unionByName(them).groupBy("grouped", "band", "i", "j").applyInArrow(compare, "a long, b long")


def ngram_components(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, num: int = 75, den: int = 100, direct: int = DIRECT, block: int = BLOCK, salted: int = SALTED
) -> DataFrame:
    """(id, n_shingles, component_id) per row: the smallest id reachable by links of ``num / den`` or more.

    ``direct``, ``block`` and ``salted`` only steer how candidates are paired; every value gives the same result.
    """
    spark, least, scratch = df.sparkSession, Threshold(num, den), Scratch(df.sparkSession)
    scanned = scratch.stored(profiles(df, id_col, text, width))
    docs = scanned.where("found is null")
    found = scanned.where("found is not null").groupBy("d1").agg(F.sum("found").alias("n")).where(F.col("n") >= IN_ALL)
    late = found.orderBy(F.desc("n"), "d1").limit(FREQUENT).collect()
    values, counts = np.array([r.d1 for r in late], np.int64).view(np.uint64), np.array([r.n for r in late], np.int64)
    frequent = spark.sparkContext.broadcast((values, counts, 1 + counts // salted))
    own = docs.where("n > 0 and id is not null")
    classes = scratch.stored(own.groupBy("d1", "d2", "n").agg(F.min("id").alias("cid"), F.first("sketch").alias("sketch")))
    shared = scratch.stored(met(postings(df, text, width, least, frequent), least, direct))
    large = shared.where("b is null").select("a", "token", "salt", "n")
    members = scratch.stored(groups(large))
    verifier = Verifier(df, classes, id_col, text, width, least, frequent, scratch)
    first = shared.where("b is not null").select("a", "b").unionByName(hub_pairs(members, least))
    links = verifier.linked(scratch.stored(candidates(first, classes, least)))
    labels = scratch.stored(connected_components(links, scratch))
    for nearest in () if members.isEmpty() else (True, False):
        more = scratch.stored(candidates(across(members, classes, labels, least, block, nearest, scratch), classes, least))
        if more.isEmpty():
            break
        links = labels.select(F.col("member").alias("a"), F.col("component").alias("b")).unionByName(verifier.linked(more))
        labels = scratch.stored(connected_components(links, scratch))
    grouped = classes.join(labels, classes["cid"] == labels["member"], "left").select("d1", "d2", "n", F.coalesce("component", "cid").alias("component"))
    rows = docs.select("id", "n", "d1", "d2").join(grouped, ["d1", "d2", "n"], "left")
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = scratch.stored(rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id")))
    scratch.clear(keep=1)
    return out
