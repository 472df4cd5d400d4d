"""A bidirectional gated recurrent network with attention pooling, forward and backward, in numpy.

A word enters as its hashed embedding beside the mean of the hashed embeddings of its character
n-grams. Two recurrent passes read a window of words, attention weighs the joined states, and
a linear unit scores the weighted mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

WORD = re.compile(r"\w+")
#: Hash buckets of each embedding table, its width, and the width of a recurrent state.
BUCKETS, EMBED, HIDDEN = 1 << 15, 8, 8
INPUT = 2 * EMBED
#: Words whose n-grams are held as vectors at a time.
CHUNK = 1 << 15
GRAMS = (3, 5, 7)
#: Words of a window and the step to the next one; each word but those at the ends lies in two windows.
WINDOW, STEP = 32, 16

_random = np.random.Generator(np.random.PCG64(7))
_BYTE = _random.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


class Words:
    """Hashed features of distinct words: a word bucket each, and n-gram buckets with their owners."""

    def __init__(self, words: list[str]):
        data = "".join(f"<{w}>" for w in words).encode()
        b = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero(b == ord("<"))
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(b))))
        value = _BYTE[b]
        # A sum of mixed bytes by place, so that the same letters in another order differ.
        place = np.arange(len(b)) - starts[owner] if len(b) else np.empty(0, np.int64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value * _PLACE[place % 64] ^ (value >> np.uint64(7)), dtype=np.uint64)])
        ends = np.append(starts[1:], len(b))
        self.word = _bucket(sums[ends] - sums[starts]) if len(words) else np.empty(0, np.int64)
        grams, owners = [], []
        for n in GRAMS:
            m = max(0, len(b) - n + 1)
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h += value[k : k + m] * _PLACE[k]
            within = owner[:m] == owner[n - 1 : n - 1 + m] if m else np.empty(0, bool)
            grams.append(_bucket(h[within] + np.uint64(n)))
            owners.append(owner[:m][within])
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.gram, self.owner = np.concatenate(grams)[order].astype(np.int32), np.concatenate(owners)[order].astype(np.int32)
        # A word has one n-gram at least: its only letter between the two marks.
        self.first = np.searchsorted(self.owner, np.arange(len(words)))
        self.count = np.bincount(self.owner, minlength=len(words))[:, None].astype(np.float32)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Inputs of the words, and a last row of zeros that pads windows."""
        if not len(self.word):
            return np.zeros((1, INPUT), np.float32)
        out = np.zeros((len(self.word) + 1, INPUT), np.float32)
        out[:-1, :EMBED] = p["words"][self.word]
        bounds = np.append(self.first, len(self.gram))
        for i in range(0, len(self.word), CHUNK):
            j = min(i + CHUNK, len(self.word))
            chars, at = p["chars"][self.gram[bounds[i] : bounds[j]]], self.first[i:j] - bounds[i]
            out[i:j, EMBED:] = np.add.reduceat(chars, at) / self.count[i:j]
        return out

    def spread(self, dx: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        np.add.at(grad["words"], self.word, dx[:-1, :EMBED])
        np.add.at(grad["chars"], self.gram, (dx[:-1, EMBED:] / self.count)[self.owner])


def indexed(texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word of each text in turn, words per text)."""
    each = [WORD.findall((t or "").lower()) for t in texts]
    index = {w: i for i, w in enumerate(dict.fromkeys(w for ws in each for w in ws))}
    ids = np.fromiter((index[w] for ws in each for w in ws), np.int64, sum(map(len, each)))
    return list(index), ids, np.array([len(ws) for ws in each], np.int64)


def windows(ids: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(word indices of every overlapping window, text of each window); at least one per text."""
    n = np.maximum(1, -(-(counts - STEP) // STEP))
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = nth[:, None] * STEP + np.arange(WINDOW)
    inside = at < counts[text][:, None]
    first = (np.cumsum(counts) - counts)[text][:, None]
    padded = np.append(ids, pad)
    return padded[np.where(inside, first + at, len(ids))].astype(np.int32), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    p = {k: r.normal(0, 0.1, (BUCKETS, EMBED)) for k in ("words", "chars")}
    for side in ("f", "b"):
        p["w" + side] = r.normal(0, 0.3, (INPUT, 3 * HIDDEN))
        p["u" + side] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p["c" + side] = np.zeros(3 * HIDDEN)
    return {k: v.astype(np.float32) for k, v in (p | {"v": r.normal(0, 0.3, 2 * HIDDEN), "o": r.normal(0, 0.3, 2 * HIDDEN), "d": np.zeros(1)}).items()}


def _pass(projected: np.ndarray, ids: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    """States of one direction for all windows, time first."""
    out = np.empty((ids.shape[1], ids.shape[0], HIDDEN), np.float32)
    h = np.zeros((ids.shape[0], HIDDEN), np.float32)
    for t in range(ids.shape[1] - 1, -1, -1) if back else range(ids.shape[1]):
        a, g = projected[ids[:, t]], h @ u
        gates = sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
        h = c + z * (h - c)
        out[t] = h
    return out


def forward(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logits of windows over the word inputs ``x``, whose last row is padding."""
    sides = []
    for side in ("f", "b"):
        keep = [] if kept is not None else None
        sides.append(_pass(x @ p["w" + side] + p["c" + side], ids, p["u" + side], side == "b", keep))
        if kept is not None:
            kept[side] = keep
    h = np.concatenate(sides, axis=2)
    e = h @ p["v"]
    e[ids.T == len(x) - 1] = -1e9
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", alpha, h)
    if kept is not None:
        kept |= {"h": h, "alpha": alpha, "pooled": pooled}
    return pooled @ p["o"] + p["d"]


def backward(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, kept: dict, d: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
    """Add gradients for the logit gradients ``d`` to ``grad``; returns those of ``x``."""
    h, alpha, pooled = kept["h"], kept["alpha"], kept["pooled"]
    grad["d"] += d.sum()
    grad["o"] += d @ pooled
    dp = d[:, None] * p["o"]
    de = alpha * (np.einsum("tnk,nk->tn", h, dp) - (pooled * dp).sum(axis=1))
    dh = alpha[:, :, None] * dp + de[:, :, None] * p["v"]
    grad["v"] += np.einsum("tn,tnk->k", de, h)
    dx = np.zeros_like(x)
    for at, side in ((slice(0, HIDDEN), "f"), (slice(HIDDEN, None), "b")):
        u, w = p["u" + side], p["w" + side]
        carry = np.zeros((ids.shape[0], HIDDEN), np.float32)
        for t, before, z, r, c, gc in reversed(kept[side]):
            s = dh[t][:, at] + carry
            dc = s * (1 - z) * (1 - c * c)
            dz = s * (before - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            da, dg = np.concatenate([dz, dr, dc], axis=1), np.concatenate([dz, dr, dc * r], axis=1)
            grad["u" + side] += before.T @ dg
            grad["c" + side] += da.sum(axis=0)
            grad["w" + side] += x[ids[:, t]].T @ da
            np.add.at(dx, ids[:, t], da @ w.T)
            carry = s * z + dg @ u.T
    return dx


def window_scores(p: dict[str, np.ndarray], texts: Iterable[str | None], batch: int = 4096) -> Iterator[np.ndarray]:
    """(logits of all windows, text of each window) of a block of texts."""
    words, ids, counts = indexed(texts)
    x = Words(words).vectors(p)
    rows, text = windows(ids, counts, len(words))
    logits = np.concatenate([forward(p, x, rows[i : i + batch]) for i in range(0, len(rows), batch)]) if len(rows) else np.empty(0, np.float32)
    return logits, text


def text_scores(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """The highest window probability of each text."""
    logits, text = window_scores(p, texts)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, logits)
    return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def _log_odds(found: Iterator[tuple[np.ndarray, int]], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket by the share of texts of either label that have it; ``found`` gives a text's buckets and label."""
    hits = np.zeros((2, BUCKETS), np.int64)
    for buckets, label in found:
        hits[label, np.unique(buckets)] += 1
    share = [(hits[y] + 0.5) / (max(1, (labels == y).sum()) + 1) for y in (0, 1)]
    return np.where(hits.sum(axis=0) > 2, np.clip(np.log(share[1] / share[0]), -2, 4), 0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 1) -> dict[str, np.ndarray]:
    """Fit to text labels: each epoch takes every text's highest window under the model so far.

    The first embedding axes start as log odds of their buckets, so the first choice of
    windows already tells something. Adam; classes weigh the same.
    """
    p = initial(seed)
    words, ids, counts = indexed(texts)
    features = Words(words)
    of_text = np.split(ids, np.cumsum(counts)[:-1])
    of_word = np.split(features.gram, features.first[1:])
    p["words"][:, 0] = _log_odds(((features.word[w], y) for w, y in zip(of_text, labels)), labels)
    p["chars"][:, 0] = _log_odds(((np.concatenate([of_word[k] for k in np.unique(w)]), y) for w, y in zip(of_text, labels) if len(w)), labels)
    rows, text = windows(ids, counts, len(words))
    weight = np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum()))).astype(np.float32)
    r = np.random.Generator(np.random.PCG64(seed))
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    x = features.vectors(p)
    hint = np.append(x[:-1, 0], -9)[rows].max(axis=1)
    for epoch in range(epochs):
        score = hint if not epoch else np.concatenate([forward(p, x, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
        by = np.lexsort((-score, text))
        chosen = by[np.searchsorted(text[by], np.arange(len(texts)))]
        # Beside the highest window of each text, clean texts give windows drawn at random, two for every text.
        extra = r.permutation(np.flatnonzero(labels[text] == 0))[: 2 * len(texts)]
        picked = r.permutation(np.concatenate([chosen, extra]))
        for i in range(0, len(picked), batch):
            own = rows[picked[i : i + batch]]
            used, local = np.unique(np.append(own.ravel(), len(words)), return_inverse=True)
            local = local[:-1].reshape(own.shape)
            part = Words([words[k] for k in used[:-1]])
            x, kept = part.vectors(p), {}
            y = labels[text[picked[i : i + batch]]]
            d = (sigmoid(forward(p, x, local, kept)) - y) * weight[text[picked[i : i + batch]]] / len(own)
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            part.spread(backward(p, x, local, kept, d.astype(np.float32), grad), grad)
            step += 1
            for k, g in grad.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        x = features.vectors(p)
    return p
