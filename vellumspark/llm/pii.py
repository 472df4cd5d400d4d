"""Offset-preserving search for personal data, in plain and in disguised form.

A text is searched as it is (the base spans). Then a chain of transducers rewrites it: look-alike
and compatibility characters become ASCII, invisible ones vanish, spelled digits become digits,
"at" and "dot" disguises become @ and full stops. Every transducer carries for each character
it writes the source characters it stands for, so what the same detectors find in the rewritten
text maps back to spans of the source. Base spans stay; new ones are added.

All work is a projection of each document in the task that scans it: no shuffle, memory bounded
by a block of texts. Every pattern runs in time linear in the text.

Defined results: a null or empty text has no spans; a very long one is searched to its end, in a
block of its own; repeated rows are searched one by one; of overlapping spans all stand, in the
order of start, then kind; further columns, whatever their names, are not read by the search and
stay as they are in ``redact``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.llm.common import blocks

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of all kinds, each kind leftmost and without overlap, by start and then kind."""
    spans: list[Span] = []
    last = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                last = m.end()
    for m in DOTTED.finditer(text):
        # A chain of dotted numbers is used up four parts at a time.
        parts = list(re.finditer("[0-9]+", m.group()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(v := p.group().lstrip("0")) <= 3 and int(v or 0) <= 255 for p in parts[k : k + 4]):
                spans.append((m.start() + parts[k].start(), 1, m.start() + parts[k + 3].end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# Characters of other scripts that look like an ASCII one.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝкмтвнгАВЕКМНОРСТУХІЈЅЗ" "αεορντυικηχγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɡɑ‐‑‒–—−․。·∙•",
        "aeopcyxijsdhlqwkmtbhrABEKMHOPCTYXIJS3" "aeopvtuiknxywABEZHIKMNOPTYX" "iga------.....",
    )
)
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _folds() -> dict[str, str]:
    """Single characters and what they fold to: compatibility forms of ASCII (full width, mathematical,
    circled), decimal digits of any script, spaces, look-alikes; invisible ones fold to nothing."""
    found = {}
    for code in (*range(0x100, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            found[c] = str(digit)
        elif len(plain) == 1 and "\x20" <= plain < "\x7f" and not 0x2070 <= code < 0x20A0:
            found[c] = plain
    return found | {" ": " "} | LOOK_ALIKES | dict.fromkeys(INVISIBLE, "")


FOLDS = _folds()
FOLDED = re.compile("[" + "".join(map(re.escape, FOLDS)) + "]")

# Digits spelled in the four languages served.
SPELLED = {
    word: str(digit)
    for digit, words in enumerate(
        (
            "zero oh null zéro cero",
            "one eins un une uno",
            "two zwei zwo deux dos",
            "three drei trois tres",
            "four vier quatre cuatro",
            "five fünf cinq cinco",
            "six sechs seis",
            "seven sieben sept siete",
            "eight acht huit ocho",
            "nine neun neuf nueve",
        )
    )
    for word in words.split()
}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DOT = "(?:dot|point|punkt|punto)"
_GAP = r"[\s,()-]{1,3}"
_ITEM = rf"(?:{_WORD}|[0-9]{{1,4}})(?![^\W_])"
#: At least three items in a row, two spelled ones among the first three kept by the test in _digits.
RUN = re.compile(rf"(?<![^\W_])(?:plus{_GAP}(?={_WORD}))?{_ITEM}(?:{_GAP}(?:{_DOT}{_GAP})?{_ITEM}){{2,}}", re.I)
#: A spelled digit beside another item, in a lower-case text with a space in front: every run with a spelled digit has one.
BESIDE_SPELLED = re.compile(rf"[\W_](?:{_WORD}{_GAP}(?:{_DOT}{_GAP})?{_ITEM}|[0-9]{{1,4}}{_GAP}(?:{_DOT}{_GAP})?{_WORD}(?![^\W_]))")
PIECES = re.compile(rf"{_WORD}|{_DOT}|plus|[0-9]", re.I)

# Words for @ and for the full stop in the four languages served.
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|ät", "dot|punkt|punto|point"
_SIGN = rf"\s?(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)\s?"
WRAPPED = re.compile(rf"\s{{0,3}}(?:\[{_SIGN}\]|\({_SIGN}\)|\{{{_SIGN}\}}|<{_SIGN}>)\s{{0,3}}", re.I)
IS_AT = re.compile(rf"{_AT_WORDS}|@", re.I)
#: Top-level domains without which bare "at" and "dot" words are ordinary prose.
TOP = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|eu|us|ca|ch|at|it|nl|ru|example|test"
_BARE_DOT = rf"(?:\s{{1,3}}(?:{_DOT_WORDS}|\.)\s{{1,3}}|[_-](?:{_DOT_WORDS})[_-])"
_LABEL = "[A-Za-z0-9-]{1,63}"
BARE = re.compile(rf"(?:\s{{0,3}}@\s{{0,3}}|\s{{1,3}}(?:{_AT_WORDS})\s{{1,3}}|[_-](?:{_AT_WORDS})[_-])(?={_LABEL}(?:(?:\.|{_BARE_DOT}){_LABEL}){{0,8}}?(?:\.|{_BARE_DOT})(?:{TOP})(?![A-Za-z0-9-]))", re.I)
#: In a lower-case text without @: what every "at" of BARE and every dot of NUMBER_DOT has.
AT_OR_DOT = re.compile(rf"[\s_-](?:{_AT_WORDS}|dot)[\s_-]")
BARE_DOT = re.compile(_BARE_DOT, re.I)
BEFORE_DOT = re.compile(rf"{_BARE_DOT}$", re.I)
BARE_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_BARE_DOT}){_LABEL}){{1,9}}", re.I)
LAST_DOT = re.compile(rf"(?:\.|{_BARE_DOT})(?:{TOP})(?![A-Za-z0-9-])", re.I)
NUMBER_DOT = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl|](?:[\x20-]?[0-9OoIl|]){11,18}(?![A-Za-z0-9])")
MIXED_DIGITS = str.maketrans("OoIl|", "00111")


class Mapped(NamedTuple):
    """A rewritten text; character i stands for source[start[i]:end[i]]."""

    text: str
    start: np.ndarray
    end: np.ndarray


def rewritten(m: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    """``m`` with each (from, to, new text) in place; edits are ordered and do not overlap."""
    if not edits:
        return m
    texts, starts, ends, at = [], [], [], 0
    for a, b, new in edits:
        texts += (m.text[at:a], new)
        starts += (m.start[at:a], np.full(len(new), m.start[a]))
        ends += (m.end[at:a], np.full(len(new), m.end[b - 1]))
        at = b
    return Mapped("".join([*texts, m.text[at:]]), np.concatenate([*starts, m.start[at:]]), np.concatenate([*ends, m.end[at:]]))


def _folding(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), FOLDS[m.group()]) for m in FOLDED.finditer(text)]


def _digits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for m in RUN.finditer(text):
        parts = list(PIECES.finditer(text, m.start(), m.end()))
        if sum(p.group().lower() in SPELLED for p in parts) < 2:
            continue
        for i, p in enumerate(parts):
            word = p.group().lower()
            new = SPELLED.get(word) or ("+" if word == "plus" else word if word.isdigit() else ".")
            if new != p.group():
                edits.append((p.start(), p.end(), new))
            if i + 1 < len(parts) and parts[i + 1].start() > p.end():
                edits.append((p.end(), parts[i + 1].start(), ""))
    return edits


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if IS_AT.search(m.group()) else ".") for m in WRAPPED.finditer(text)]


def _bare(text: str) -> list[tuple[int, int, str]]:
    """"at" and "dot" words between a local part and a domain that ends in a known top-level domain."""
    edits: dict[int, tuple[int, int, str]] = {}
    for m in BARE.finditer(text):
        before: list[tuple[int, int, str]] = []
        i = m.start()
        while True:
            j = i
            while j > 0 and text[j - 1] in LOCAL and i - j < 64:
                j -= 1
            if j == i:
                break
            dot = BEFORE_DOT.search(text[max(0, j - 12) : j])
            if not dot or len(before) > 8:
                break
            i = max(0, j - 12) + dot.start()
            before.append((i, j, "."))
        if m.start() and text[m.start() - 1] in LOCAL:
            domain = BARE_DOMAIN.match(text, m.end())
            last = max((d.start() for d in LAST_DOT.finditer(domain.group())), default=-1) if domain else -1
            dots = [(domain.start() + d.start(), domain.start() + d.end(), ".") for d in BARE_DOT.finditer(domain.group()) if d.start() <= last] if domain else []
            for e in (*before, (m.start(), m.end(), "@"), *dots):
                if text[e[0] : e[1]] != e[2]:
                    edits.setdefault(e[0], e)
    for m in NUMBER_DOT.finditer(text):
        edits.setdefault(m.start(), (m.start(), m.end(), "."))
    kept: list[tuple[int, int, str]] = []
    for e in sorted(edits.values()):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for digits inside a number that passes the check sum."""
    edits = []
    for m in MIXED.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if sum(map(str.isdigit, digits)) >= 8 and luhn(digits.translate(MIXED_DIGITS)):
            edits += [(m.start() + i, m.start() + i + 1, c.translate(MIXED_DIGITS)) for i, c in enumerate(m.group()) if c in "OoIl|"]
    return edits


def _near_spelled(text: str) -> bool:
    # A dotted capital I is an i to the patterns, and two characters in lower case.
    return BESIDE_SPELLED.search(" " + text.lower().replace("i\u0307", "i")) is not None


def _at_or_dot(text: str) -> bool:
    return "@" in text or AT_OR_DOT.search(text.lower()) is not None


#: The chain, each with a cheap test that is true of every text it can change.
TRANSDUCERS: tuple[tuple[Callable[[str], bool], Callable[[str], list[tuple[int, int, str]]]], ...] = (
    (lambda t: not t.isascii() and not FOLDS.keys().isdisjoint(set(t)), _folding),
    (_near_spelled, _digits),
    (lambda t: any(c in t for c in "[({<"), _wrapped),
    (_at_or_dot, _bare),
    (lambda t: True, _mixed),
)


def normalised(text: str) -> Mapped | None:
    """The rewritten text with its offsets; None if no transducer changes it."""
    m = None
    for may, edits_of in TRANSDUCERS:
        now = m.text if m else text
        if may(now) and (edits := edits_of(now)):
            m = rewritten(m or Mapped(text, np.arange(len(text)), np.arange(1, len(text) + 1)), edits)
    return m


def find_personal_data(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    text = text or ""
    base = detect(text)
    m = normalised(text)
    if m is None:
        return base, base
    mapped = {(int(m.start[s]), kind, int(m.end[e - 1])) for s, kind, e in detect(m.text)}
    return base, sorted(mapped.union(base))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str | None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in find_personal_data(text)[1]:
        if not out or start >= at:
            out += (text[at:start], f"[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each document.

    The four counts and ``base_sha256`` are of the base spans, ``spans`` lists all, and ``n_added``
    is how many of them the transducers brought.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 4 << 20):
            found = [find_personal_data(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            columns += [
                pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([written(every) for _, every in found], pa.string()),
                pa.array([len(every) - len(base) for base, every in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(search, f"id long, {SCHEMA}, n_added long")
    return rows.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data of its text column replaced; all other columns stay, whatever their names and order."""
    rest = [c for c in df.columns if c != text]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 4 << 20):
            texts = pa.array([redacted(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["rest", "text"])

    packed = df.select((F.struct(*rest) if rest else F.lit(0)).alias("rest"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["rest"], T.StructField("text", T.StringType())])
    done = packed.mapInArrow(replace, schema)
    return done.select(*(F.col("text").alias(text) if c == text else F.col("rest")[c].alias(c) for c in df.columns))
