"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates and queries are dealt into blocks by hash, and every query block meets every candidate
block in a task of its own. Blocks are as large as memory allows (``BLOCK_BYTES``) once there are
enough of them to keep the tasks busy, so that few copies of either side are sent.

Inside a task the candidates are taken ``LISTS`` at a time. Each dimension is a list of them sorted by
component; a query reads it from the top where its own component is positive and from the bottom
where it is negative, a step at a time. What has been read gives each candidate a lower bound
(unread entries count as the end of their list) and an upper bound (unread entries count as the
frontier). A candidate whose upper bound is below the query's bar drops out for that query. The bar
is the k-th best score known: of final scores in the lists before, here or, by a first round over
one block of candidates, in any task; of lower bounds as long as there are none. Bounds are looked
at once the frontier alone, the bound of what has not been met at all, is below the bar. A query
stops reading when few candidates are left, and the scores of those alone are resolved. Bounds and scores are sums of
products of integers, exact in the chosen float type.

Each task returns k rows per query at most, none of them below the bar of the first round, and a
window keeps the best k.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no
part; rows equal in id and vector count once, other rows that share an id each take part, as
candidates and as queries, whose k best are taken together; vectors of unequal length count as
padded with zeros, and very long ones make blocks of fewer rows; ties go to the smaller id; further
columns, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellumspark.llm.common import partitions_for, stored

#: Shares of the lists read before each look at the bounds.
DEPTHS = tuple(i / 16 for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14))
#: A query stops reading when this share of the candidates of its lists, or less, is left.
FEW = 1 / 16
#: Candidates whose lists are read together, and queries that read them together.
LISTS, READERS = 2048, 512
#: Bytes of a block of candidates or queries, as doubles.
BLOCK_BYTES = 32 << 20


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x) in double, one row per id and vector."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")).cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(id_col, vector).distinct().select(F.col(id_col).alias("id"), v.alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles, short lists padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exact_type(x: np.ndarray, q: np.ndarray) -> type:
    """The narrowest type in which every sum of products is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Reader:
    """The k best candidates of each query of a block, over lists read one set after the other."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray):
        self.query_ids, self.q, self.k = query_ids, q, k
        #: The least score that can still enter each query's result.
        self.bar = bar.astype(np.float64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        #: Entries read from lists or to resolve scores, and entries there are.
        self.read = self.entries = 0

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Read the lists of one set of candidates."""
        kind = exact_type(x, self.q)
        for start in range(0, len(self.query_ids), READERS):
            rows = np.arange(start, min(start + READERS, len(self.query_ids)))
            if kind is object:
                pairs = np.nonzero(self.query_ids[rows][:, None] != ids[None, :])
                scores = [sum(int(a) * int(b) for a, b in zip(self.q[rows[i]].tolist(), x[j].tolist())) for i, j in zip(*pairs)]
                self.keep(rows, ids, *pairs, scores)
            else:
                self.keep(rows, ids, *self.survivors(rows, ids, x.astype(kind), self.q[rows].astype(kind)))

    def survivors(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the candidates that no bound excludes."""
        m, d = x.shape
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        order = np.argsort(-x, axis=0, kind="stable")
        place = np.empty(x.shape, np.int32)
        np.put_along_axis(place, order, np.arange(m, dtype=np.int32)[:, None], axis=0)
        least, most = x.min(axis=0), x.max(axis=0)
        alive = self.query_ids[rows][:, None] != ids[None, :]
        reading, self.entries = np.arange(len(rows)), self.entries + d * m * len(rows)
        depth = 0
        for share in DEPTHS:
            before, depth = depth, math.ceil(share * m)
            if m <= self.k or not len(reading):
                break
            self.read += d * (depth - before) * len(reading)
            top, bottom = x[order[depth - 1], np.arange(d)], x[order[m - depth], np.arange(d)]
            unmet = up[reading] @ top + down[reading] @ bottom
            known = np.isfinite(self.bar[rows[reading]])
            looking = reading[~known | (unmet < self.bar[rows[reading]])]
            if not len(looking):
                continue
            some = np.flatnonzero(alive[looking].any(axis=0))
            read_top, read_bottom = place[some] < depth, place[some] >= m - depth
            upper = up[looking] @ np.where(read_top, x[some], top).T + down[looking] @ np.where(read_bottom, x[some], bottom).T
            fresh = looking[~np.isfinite(self.bar[rows[looking]])]
            if len(fresh) and len(some) >= self.k:
                lower = up[fresh] @ np.where(read_top, x[some], least).T + down[fresh] @ np.where(read_bottom, x[some], most).T
                lower[~alive[np.ix_(fresh, some)]] = -np.inf
                bars = np.partition(lower, len(some) - self.k, axis=1)[:, len(some) - self.k]
                alive[np.ix_(fresh, some)] &= upper[np.isin(looking, fresh)] >= bars[:, None]
            alive[np.ix_(looking, some)] &= upper >= self.bar[rows[looking]][:, None]
            reading = reading[alive[reading].sum(axis=1) > max(self.k, FEW * m)]
        i, j = np.nonzero(alive)
        self.read += d * len(i)
        if len(i) > alive.size // 4:
            return i, j, (q @ x.T)[i, j]
        step = max(1, (4 << 20) // d)
        return i, j, np.concatenate([np.einsum("pd,pd->p", q[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step)] or [np.empty(0)])

    def keep(self, rows: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, scores) -> None:
        """Add final scores to the best of each query, and raise its bar."""
        scores = np.asarray(scores, dtype=object if len(scores) and isinstance(scores[0], int) else None)
        bounds = np.searchsorted(i, np.arange(len(rows) + 1))
        for r, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            own, own_ids = scores[a:b], ids[j[a:b]]
            if scores.dtype != object and b - a > self.k:
                fine = own >= np.partition(own, b - a - self.k)[b - a - self.k]
                own, own_ids = own[fine], own_ids[fine]
            found = self.best[r] + [(-int(s), int(c)) for s, c in zip(own.tolist(), own_ids.tolist())]
            self.best[r] = sorted(found)[: self.k]
            if len(self.best[r]) == self.k:
                self.bar[r] = max(self.bar[r], float(-self.best[r][-1][0]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, candidate ids, scores) of the best; scores beyond a long's range saturate."""
        flat = [(int(q), c, max(-(2**63), min(2**63 - 1, -s))) for q, best in zip(self.query_ids, self.best) for s, c in best]
        return tuple(np.array([f[k] for f in flat], np.int64) for k in range(3))


def n_blocks(n: int, width: int, block: int, tasks: int) -> int:
    """Blocks of ``block`` rows up to ``tasks`` of them; beyond, larger ones up to ``BLOCK_BYTES``."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    return max(1, math.ceil(n / most), min(math.ceil(n / block), tasks))


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates for each row whose id ``every`` divides.

    ``block``: least vectors of a candidate block. Scores beyond the range of a long saturate at its ends.
    """
    rows = stored(whole_vectors(df, id_col, vector, scale))
    asked = rows.where(F.col("id") % every == 0)
    n, width, n_asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    tasks = 2 * partitions_for(df)
    n_b, n_q = n_blocks(n, width or 0, block, tasks), n_blocks(n_asked, width or 0, n_asked or 1, 1)
    mine = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    candidates = rows.select("id", "v", mine(n_b).alias("b"))
    queries = asked.select("id", "v", mine(n_q).alias("q"))
    first = best_of(candidates.where("b = 0"), queries.withColumn("bar", F.lit(None).cast("long")), [0], n_q, k)
    first = stored(first)
    bars = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), False)[k - 1]).alias("bar"))
    told = queries.join(bars.select(F.col("query_id").alias("id"), "bar"), "id", "left").select("id", "v", "q", "bar")
    rest = best_of(candidates.where("b > 0"), told, range(1, n_b), n_q, k)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(candidates: DataFrame, queries: DataFrame, numbers, n_q: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of candidates (id, v, b), of those ``numbers``, for each query (id, v, q, bar)."""
    numbers = list(numbers)
    left = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    queries = queries.select(F.col("id").alias("asker"), F.col("v").alias("asked"), "q", "bar")
    right = queries.withColumn("b", F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1])))) if numbers else queries.withColumn("b", F.lit(0)).where("false")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            width = max(pc.max(pc.list_value_length(t)).as_py() for t in (left["v"], right["asked"]))
            ids, x = left["id"].to_numpy(), matrix(left["v"], width)
            bar = np.array([-np.inf if b is None else b for b in right["bar"].to_pylist()])
            reader = Reader(right["asker"].to_numpy(), matrix(right["asked"], width), k, bar)
            for start in range(0, len(ids), LISTS):
                reader.take(ids[start : start + LISTS], x[start : start + LISTS])
            found = reader.rows()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(meet, "query_id long, vec_id long, score long")
