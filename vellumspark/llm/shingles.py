"""Word shingles of texts as sorted 64-bit fingerprints, computed a block at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vellumspark.llm.common import blocks

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; white space has 0 and A-Z those of a-z.
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True
BYTE[IS_WHITE] = 0
BYTE[65:91] = BYTE[97:123]
#: Odd multipliers of a word's place in its shingle.
PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Base of the polynomial over a word's bytes, 3 modulo 8 so that its powers are far apart, and its inverse.
BASE = 0x9E3779B97F4A7C13
BASE_INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words are runs of anything but white space, A-Z in lower case."""
    data, offsets = _text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~IS_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _powers(BASE, len(data)), dtype=np.uint64, out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers(BASE_INVERSE, len(data))[starts]
    counts = np.diff(np.searchsorted(starts, offsets))
    return mixed(words + (ends - starts).astype(np.uint64)), counts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, set sizes): each text's distinct shingles in ascending order, text after text.

    A text of fewer than ``width`` words has its whole sequence as one shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    total = max(0, len(words) - width + 1)
    h = np.zeros(total, np.uint64)
    for k in range(width):
        h += words[k : k + total] * PLACE[k]
    within = text[:total] == text[width - 1 : width - 1 + total] if total else np.empty(0, bool)
    h, owner = mixed(h[within], 1), text[:total][within]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([mixed((words[first[t] : first[t] + counts[t]] * PLACE[: counts[t]]).sum(dtype=np.uint64, keepdims=True), int(counts[t]) + 1)[0] for t in short], np.uint64)
        at = np.searchsorted(owner, short)
        h, owner = np.insert(h, at, extra), np.insert(owner, at, short)
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)


def shingled(batches: Iterator[pa.RecordBatch], width: int, text_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(block of rows, fingerprints, set sizes) for each block of texts."""
    for block in blocks(batches, text_bytes):
        yield (block, *shingle_sets(block.column(1), width))


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of consecutive runs of the given sizes."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def digests(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set that do not depend on order."""
    return mixed(summed(mixed(h, 101), sizes) + sizes.astype(np.uint64)), mixed(summed(mixed(h, 202), sizes))


#: Least bits of a sketch.
LEAST_BITS = 256


def sketches(h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parity bits of each set, as many as the next power of two from its size: every element turns one over.

    Where two sketches differ in d bits, the sets differ in d elements at least. A longer sketch
    folds onto a shorter one by exclusive or of its halves.
    """
    width = np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    first = np.cumsum(width) - width
    at = np.repeat(first, sizes) + (h >> U(8) & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    bits = np.bincount(at, minlength=int(width.sum())) & 1
    offsets = np.append(first, width.sum()) // 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.packbits(bits.astype(np.uint8), bitorder="little"))])


def folded(sketch: bytes, n_bytes: int) -> np.ndarray:
    """A sketch folded to ``n_bytes``, as 64-bit words."""
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, n_bytes // 8), axis=0)


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the length of the shorter one."""
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())
