"""SentencePiece encoding and decoding by suffix-array matching.

A block of texts falls into pre-tokens (white space, then what is not; no piece reaches across).
The block's distinct pre-tokens are joined into one text whose suffixes are sorted as far as the
longest piece. A binary search per piece finds its range of suffixes, and so every occurrence of
every piece: the edges of all lattices. Edges are sorted by where they end and relaxed in that
order.

The model is a byte-pair one, whose result is no highest sum of scores but what its merges leave.
So an edge relaxes its end if the piece can follow the piece that ends where it starts, that is
if no merge of higher priority would cross their boundary. Exactly one piece passes at each
end, and the path is the merges' result. Characters outside the model become byte pieces.

Texts are encoded where they are scanned; memory follows the block.

Defined results: a null or empty text has no pieces, and no ids decode to the empty text; repeated
rows are encoded one by one; a very long text is a block of its own, and a pre-token without end is
relaxed in one step a character; further columns, whatever their names, are not read; an empty
table gives an empty table; of merges of one rank the leftmost goes first, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import blocks
from vellumspark.llm.tokencount import encodable, processor

NEVER = np.iinfo(np.int64).max
SPACE = "▁"
#: Slots of the cache of piece pairs.
SLOTS = 1 << 21


class Model:
    """Tables of a model: pieces, how each is put together, and which pairs merge into which piece."""

    def __init__(self, path: str):
        sp = processor(path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        is_byte = set(self.byte)
        self.rank = np.array([round(-sp.get_score(i)) for i in range(size)], np.int64)
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in is_byte}
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.reached = np.zeros(size, bool)
        for p, i in self.id.items():
            tokens, last = self.merges(p)
            self.reached[i] = len(tokens) == 1
            if last and self.reached[i]:
                self.left[i], self.right[i] = last
        self.spaces = np.array([p.startswith(SPACE * 2) for p in self.pieces])
        pairs = [(self.id[p[:k]] * size + self.id[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_piece = np.array([i for _, i in pairs], np.int32)
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        self.longest = max(map(len, self.id))

    def merges(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """(pieces, the last pair merged) of a short text by the rule itself: best rank first, leftmost among equals."""
        tokens = list(text)
        last = None
        while True:
            best = min(((self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in self.id), default=None)
            if best is None:
                return [self.id.get(t, -1) for t in tokens], last
            k = best[1]
            last = self.id.get(tokens[k], -1), self.id.get(tokens[k + 1], -1)
            tokens[k : k + 2] = [tokens[k] + tokens[k + 1]]

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces apart."""
        ok = np.ones(len(first), bool)
        size = len(self.pieces)
        x, until_x = first.astype(np.int64), np.full(len(first), NEVER)
        on = np.arange(len(first))
        # Down the right edge of the first piece and the left edge of the second: a part exists until it merges into its parent.
        while len(on):
            y, until_y, still = second[on].astype(np.int64), np.full(len(on), NEVER), np.arange(len(on))
            while len(still):
                key = x[on[still]] * size + y[still]
                at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                hit = self.pair_key[at] == key
                rank = np.where(hit, self.rank[self.pair_piece[at]], NEVER)
                crossed = hit & (rank < until_x[on[still]]) & (rank <= until_y[still])
                ok[on[still[crossed]]] = False
                down = self.left[y[still]]
                until_y[still] = self.rank[y[still]]
                y[still] = down
                still = still[(down >= 0) & ~crossed]
            down = self.right[x[on]]
            until_x[on] = self.rank[x[on]]
            x[on] = down
            on = on[(down >= 0) & ok[on]]
        for k in np.flatnonzero(self.spaces[first] | self.spaces[second]):
            pair = [int(first[k]), int(second[k])]
            ok[k] = self.merges(self.pieces[pair[0]] + self.pieces[pair[1]])[0] == pair
        return ok


class Pairs:
    """``Model.follows`` behind a cache of fixed size, one slot per hash."""

    def __init__(self, model: Model):
        self.model = model
        self.key = np.full(SLOTS, -1, np.int64)
        self.ok = np.zeros(SLOTS, bool)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) * len(self.model.pieces) + second
        slot = (key * -7046029254386353131 >> 40) & (SLOTS - 1)
        ok, miss = self.ok[slot], np.flatnonzero(self.key[slot] != key)
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            found = self.model.follows(new // len(self.model.pieces), new % len(self.model.pieces))
            ok[miss] = found[inverse]
            self.key[slot[miss]], self.ok[slot[miss]] = key[miss], ok[miss]
        return ok


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes' first ``depth`` characters: the first few
    characters packed into one key, then doubling."""
    alphabet, code = np.unique(text, return_inverse=True)
    k = 4 if len(alphabet) < 1 << 16 else 2
    key, width = np.zeros(len(text), np.uint64), np.uint64(64 // k)
    for j in range(k):
        key <<= width
        key[: len(text) - j] |= (code[j:] + 1).astype(np.uint64)
    while True:
        order = np.argsort(key)
        if k >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:-k] += rank[k:] + 1
        k *= 2


def occurrences(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the suffix order that start with each piece (rows of ``pieces``, padded with -1)."""
    padded = np.append(text, np.full(pieces.shape[1], -2, text.dtype))
    bounds = []
    for past in (False, True):
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            sign = np.zeros(len(open_), np.int8)
            for j in range(pieces.shape[1]):
                live = np.flatnonzero((sign == 0) & (lengths[open_] > j))
                if not len(live):
                    break
                c, p = padded[at[live] + j], pieces[open_[live], j]
                sign[live] = np.sign(c.astype(np.int64) - p)
            right = (sign < 0) | (past & (sign == 0))
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.pairs = Pairs(model)
        ids = np.array([i for i in model.id.values() if model.reached[i]], np.int64)
        self.ids = ids
        self.lengths = np.array([len(model.pieces[i]) for i in ids])
        self.rows = np.full((len(ids), model.longest), -1, np.int32)
        for row, i in zip(self.rows, ids):
            row[: len(model.pieces[i])] = np.frombuffer(model.pieces[i].encode("utf-32-le"), np.int32) + 1

    def distinct(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in turn, ids per pre-token)."""
        sizes = np.array([len(t) for t in tokens])
        first = np.cumsum(sizes + 1) - (sizes + 1)
        edge = np.zeros(int((sizes + 1).sum()) + 1, bool)
        edge[first[1:] - 1] = True
        edge[-2:] = True
        # Code points count from 1; 0 parts the pre-tokens.
        text = np.zeros(len(edge) - 1, np.int32)
        text[~edge[:-1]] = np.frombuffer("".join(tokens).replace(" ", SPACE).encode("utf-32-le"), np.int32) + 1
        order = suffix_array(text, self.model.longest).astype(np.int32)
        here = np.isin(self.rows[:, 0], np.unique(text))
        rows, lengths, ids = self.rows[here], self.lengths[here], self.ids[here]
        low, high = occurrences(text, order, rows, lengths)
        count = high - low
        at = np.repeat((low - np.cumsum(count) + count).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        place = order[at]
        del order, at
        piece, length = np.repeat(ids.astype(np.int32), count), np.repeat(lengths.astype(np.int8), count)
        known = np.zeros(len(text), bool)
        known[place[length == 1]] = True
        unknown = np.flatnonzero(~known & ~edge[:-1]).astype(np.int32)
        nobody = len(self.model.pieces)
        place = np.concatenate([place, unknown])
        piece = np.concatenate([piece, np.full(len(unknown), nobody, np.int32)])
        end = place + np.concatenate([length, np.ones(len(unknown), np.int8)])
        depth = end - np.repeat(first.astype(np.int32), sizes + 1)[place]
        depth = depth.astype(np.int16) if sizes.max(initial=0) < 32000 else depth
        by = np.argsort(depth, kind="stable").astype(np.int32)
        place, piece, end, depth = place[by], piece[by], end[by], depth[by]
        del by, length
        last = np.full(len(text) + 1, nobody, np.int32)
        before = np.full(len(text) + 1, -1, np.int32)
        bounds = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2), side="left")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            p, q = last[place[a:b]], piece[a:b]
            ok = (p == nobody) | (q == nobody)
            check = np.flatnonzero(~ok)
            ok[check] = self.pairs(p[check], q[check])
            to = end[a:b][ok]
            last[to], before[to] = q[ok], place[a:b][ok]
        used = np.zeros(len(text) + 1, bool)
        at = first + sizes
        floor = first
        while len(at):
            used[at] = True
            at = before[at]
            keep = at > floor
            at, floor = at[keep], floor[keep]
        ends = np.flatnonzero(used)
        ids = last[ends].astype(np.int64)
        owner = np.searchsorted(first, ends - 1, side="right") - 1
        return self.with_bytes(ids, owner, text[ends - 1] - 1, len(tokens))

    def with_bytes(self, ids: np.ndarray, owner: np.ndarray, chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.flatnonzero(ids == len(self.model.pieces))
        if len(out):
            ids = ids.astype(np.int32)
            coded = [chr(c).encode() for c in chars[out].tolist()]
            times = np.ones(len(ids), np.int64)
            times[out] = [len(c) for c in coded]
            owner = np.repeat(owner, times)
            at = np.repeat(np.cumsum(times)[out] - times[out], times[out])
            at = at + np.arange(len(at)) - np.repeat(np.cumsum(times[out]) - times[out], times[out])
            ids = np.repeat(ids, times)
            ids[at] = np.array(self.model.byte)[np.frombuffer(b"".join(coded), np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=n).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids per text)."""
        each = [encodable(t) for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(each))
        if not distinct:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        index = dict(zip(distinct, range(len(distinct))))
        words = np.array([len(ps) for ps in each])
        which = np.fromiter(chain.from_iterable(map(index.__getitem__, ps) for ps in each), np.int64, int(words.sum()))
        del each
        ids, sizes = self.distinct([" " + p for p in distinct])
        first = np.cumsum(sizes) - sizes
        n = sizes[which]
        flat = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text = np.repeat(np.arange(len(texts)), words)
        return ids[flat], np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)


class Decoder:
    def __init__(self, model: Model):
        self.sizes = np.array([len(s) for s in model.surface])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(model.surface), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids, without the space that the prefix stands for."""
        n = self.sizes[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        data = self.data[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_pieces, ids, round_trip): the ids of each whole text, and whether they decode to it.

    The model writes spaces as U+2581, so that character in a text decodes to a space.
    """
    tables = df.sparkSession.sparkContext.broadcast(Model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(tables.value), Decoder(tables.value)
        for batch in blocks(batches, 6 << 20):
            texts = batch.column(1).to_pylist()
            ids, counts = encoder(texts)
            same = [(t or "").replace(SPACE, " ") == d for t, d in zip(texts, decoder(ids, counts))]
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists, pa.array(same, pa.bool_())], ["id", "n_pieces", "ids", "round_trip"])
            for start in range(0, out.num_rows, 500):
                yield out.slice(start, 500)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, n_pieces long, ids array<int>, round_trip boolean")
    return rows.withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null ids give null, ids beyond the model an error."""
    tables = df.sparkSession.sparkContext.broadcast(Model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tables.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                lists = some.column(1).to_pylist()
                flat = np.fromiter(chain.from_iterable(x or () for x in lists), np.int64)
                texts = decoder(flat, np.array([len(x or ()) for x in lists], np.int64))
                column = pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), column], ["id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids)).mapInArrow(run, "id long, text string")
    return rows.withColumnRenamed("id", id_col)
