"""Collocations, the conversation trie and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import collocations as co
from vellumspark.llm import convtrie as ct
from vellumspark.llm import decontaminate as de

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def some_texts(seed, n, words):
    r = random.Random(seed)
    return [r.choice(["", " ", "\t"]) + "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r", "! ", "\x0b"]) for _ in range(r.choice([0, 1, 5, 60, 200]))) for _ in range(n)]


# 11


def phrases_brute(docs, longest=3, least=10, top=2000, share=50):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for s in range(1, longest + 1):
                for i in range(len(words) - s + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + s])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n, -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest,block,top", [(3, 1 << 20, 2000), (3, 300, 7), (4, 900, 2000), (2, 1 << 20, 3)])
def test_collocations(spark, longest, block, top):
    words = ["a", "b", "New", "york", "é", "漢字", "x", "in", "of", "the", "\x00", "q" * 50]
    texts = some_texts(5, 60, words) + [None, "", " ", "rare words only here", ("in the new york " * 400) + "end", "x" * 2000]
    docs = [(i, t, [None, "en", "en", "de", ""][i % 5], "s", None) for i, t in enumerate(texts)] + [(900, texts[-2], "en", "s", None)] * 3
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("n", "a", "block", "word", "key", "rank")})
    got = sorted(tuple(r[c] for c in COLUMNS) for r in co.collocations(df, longest=longest, top=top, block_bytes=block).collect())
    assert got == phrases_brute([(d[1], d[2]) for d in docs], longest, top=top)


def test_collocations_empty(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "a", 10**15 - 1), (2, "en", "b", 10**15 - 3)], "id long, lang string, word string, n long")
    key = (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(4)
    counts = spark.createDataFrame([(key, 999_999_999_999_998 - 10**9)], "key binary, a long")
    row = co.scored(counts, words, 3, 4).first()
    a = 999_999_999_999_998 - 10**9
    assert row.score == 1000000 * a * a // ((10**15 - 1) * (10**15 - 3))


@pytest.mark.parametrize("width", [4, 8])
def test_radix_order_and_runs(width):
    r = np.random.default_rng(1)
    keys = r.integers(0, 3, (500, 2 * width)).astype(np.uint8) * 90
    order = co.radix_order(keys)
    assert [k.tobytes() for k in keys[order]] == sorted(k.tobytes() for k in keys)
    found, counts = co.run_lengths(keys)
    assert {k.tobytes(): int(n) for k, n in zip(found, counts)} == Counter(k.tobytes() for k in keys)
    assert len(co.run_lengths(keys[:0])[0]) == 0


# 12


def rebuilt_brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    return {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + t[h:] for c, t in own.items()}


def trie_brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    below = {n: [m for m in members if m[: len(n)] == n] for n in members}
    out = []
    for n, own in members.items():
        kids = [m for m in below[n] if len(m) == len(n) + 1]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members) for m in below[n])
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below[n] if m)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(n))))
        out.append((min(own), len(n), min(members[n[:-1]]) if n else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["hi", "hello there", "", None, "é漢", "ok " * 30]
    rows = []
    for c in range(n):
        if c % 3:
            turns = [(c, k, r.choice(["user", None]), r.choice(texts[:3])) for k in range(r.choice([1, 2, 3, 9, 12]))]
        else:
            turns = [(c, None if not k else k, "user", t) for k, t in enumerate(["hi", "same", "same again"])]
        r.shuffle(turns)
        rows += turns
    return rows + [(None, 1, "user", "lost"), (7, 50, "user", "x" * 20000), (7, 50, "user", "x" * 20000)]


@pytest.mark.parametrize("run,page,held", [(16 << 20, 128 << 10, 8 << 20), (2000, 300, 500)])
def test_conversation_trie(spark, monkeypatch, run, page, held):
    rows = conversations(3, 90)
    monkeypatch.setattr(ct, "PER_RANGE", 3)
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({c: F.lit(1) for c in ("place", "conv", "key", "depth", "id", "parent")})
    got = trie_rows(ct.prefix_trie(ct.grafted(ct.placed(df))))
    assert got == trie_brute(rebuilt_brute(rows))


def test_conversation_trie_odd_tables(spark):
    assert ct.prefix_trie(ct.grafted(ct.placed(spark.createDataFrame([], TURNS)))).count() == 0
    for rows in ([(1, 0, "a", "b")], [(3, None, None, None)] * 2, [(c, 0, "a", "b") for c in range(400)]):
        assert trie_rows(ct.prefix_trie(ct.grafted(ct.placed(spark.createDataFrame(rows, TURNS))))) == trie_brute(rebuilt_brute(rows))


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_runs_with_their_shared_turns(monkeypatch, seed):
    """Runs cut into pages at random sizes merge into the sorted rows, each with what it shares with its predecessor."""
    r = random.Random(seed)
    monkeypatch.setattr(ct, "PAGE", r.choice([1, 200, 5000]))
    monkeypatch.setattr(ct, "HELD", r.choice([0, 600, 10**6]))
    turn = lambda: bytes([r.choice([0, 1, 255])]) * ct.TURN
    rows = [(b"".join(turn() for _ in range(r.randrange(5))), c, b"") for c in range(200)]
    cuts = sorted(r.sample(range(200), r.randrange(1, 9)))
    every = [p for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200])) for p in ct.pages(rows[a:b], [], k)]
    every.sort(key=lambda p: (p["head"], p["head_conv"], p["run"], p["page"]))
    got = list(ct.forecast(every))
    assert [x[:2] for x, _ in got] == sorted(x[:2] for x in rows)
    before = b""
    for (key, _, _), lcp in got:
        assert lcp == ct.shared(before, key)
        before = key


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_parts_of_ranges_join_to_the_same_nodes(ranges):
    r = random.Random(ranges)
    rows = sorted((b"".join(bytes([r.choice([1, 2])]) * ct.TURN for _ in range(k)), c, np.full(k, 3, np.int64).tobytes()) for c, k in enumerate(r.choice([0, 1, 2, 2, 6]) for _ in range(60)))
    streamed = lambda some: [(x, ct.shared(a[0] if a else b"", x[0])) for a, x in zip([None, *some], some)]
    drop = lambda rows: sorted(((n["id"], n["depth"], n["least"], n["convs"], n["children"], n["leaves"], n["saved"], n["ends_sha256"]) for n in rows))
    whole = list(ct.nodes(streamed(rows), 0))
    want = drop([n for n in whole if "ends_sha256" in n] + list(ct.joined(n for n in whole if "range" in n)))
    cuts = sorted(r.sample(range(1, 60), ranges - 1))
    found = [n for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])) for n in ct.nodes(streamed(rows[a:b]), k)]
    assert drop([n for n in found if "ends_sha256" in n] + list(ct.joined(n for n in found if "range" in n))) == want


# 13


def leaks_brute(texts, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for item, text in items:
        words = split(text)
        for i in range(len(words) - min(width, len(words)) + 1 if words else 0):
            windows[tuple(words[i : i + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, named = split(text), set(), set()
        for s in sizes:
            for i in range(len(words) - s + 1):
                if (w := tuple(words[i : i + s])) in windows:
                    hit |= set(range(i, i + s))
                    named |= {str(x) for x in windows[w] if x is not None}
        out.append((len(words), len(hit), sorted(named)))
    return out


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(8)
    words = ["Aa", "b2", "c", "é", "漢字", "d", "e", "f", "9"]
    item = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, item(30)), (10, item(10)), (9, "one two THREE"), (2, None), (None, item(15)), (3, ""), (4, "--- !"), (5, item(40)), (6, "solo")]
    items += [(1, items[0][1]), (7, items[7][1][:60]), (8, "y" * 3000)]
    texts = [None, "", " ", "One, two... three!", "x SOLO y", "y" * 3000 + " " + "y" * 2999, item(300)]
    texts += [f"{item(5)} {items[0][1].upper().replace(' ', '-')} {item(7)}", items[1][1][:-3], items[4][1], item(3) + "\n" + items[7][1] * 3, items[7][1], items[7][1]]
    return texts, items


@pytest.mark.parametrize("block", [16 << 20, 900])
def test_decontamination(spark, leaky, block):
    texts, items = leaky
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS).withColumns({c: F.lit(1) for c in ("row", "hit_words", "items", "clean", "n_hit")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    rows = sorted(de.contamination(docs, bench, block_bytes=block).collect(), key=lambda r: r.row.doc_id)
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == leaks_brute(texts, items)
    for r, text in zip(rows, texts):
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text[s.start : s.end]))) for s in r.spans) == r.n_hit
    kept = {r.doc_id for r in de.without_documents(docs, bench, block_bytes=block).collect()}
    assert kept == {i for i, x in enumerate(leaks_brute(texts, items)) if not x[1]}
    cut = de.without_spans(docs, bench, block_bytes=block)
    assert cut.columns == docs.columns
    for r in cut.collect():
        whole, left = texts[r.doc_id], ""
        for a, b in zip([0, *(s.end for s in rows[r.doc_id].spans)], [*(s.start for s in rows[r.doc_id].spans), None]):
            left += (whole or "")[a:b]
        assert r.text == (None if whole is None else left)


def test_decontamination_odd_tables(spark, leaky):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(leaky[0])], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert de.contamination(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    bench = spark.createDataFrame(leaky[1], "item_id long, text string")
    assert de.contamination(docs.limit(0), bench).count() == 0


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer(" ".join(some_texts(2, 40, ["ab", "c" * 900, "d"])).encode(), np.uint8)
    words = de.find_words(data, np.array([0, 500, 500, len(data)]), de._WORD)
    whole = de.word_hashes(words)
    monkeypatch.setattr(de, "CHUNK", 64)
    assert (de.word_hashes(words) == whole).all()
