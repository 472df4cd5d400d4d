"""Path data of many rows at a time.

What ``functions.svgpath.parse_path`` folds row by row is read here for a whole batch: one pass finds the commands and numbers of all
its paths, and the current points of all paths move on together, command by command. Results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellumspark.functions.svgpath import NUMBER, POINT

#: Commands, numbers, and the mark between paths.
TOKENS = re.compile("[MmLlHhVvCcSsQqTtAaZz\0]|" + NUMBER.replace("(?i)", "").replace("e[+-]", "[eE][+-]"), re.ASCII)
#: Numbers a command takes, and where its end point's are.
ARITY, LAST = np.full(128, 6), np.zeros(128, int)
for _kinds, _n in (("HV", 1), ("ML", 2), ("Q", 4)):
    ARITY[[ord(k) for k in _kinds]] = _n
LAST[ord("C")], LAST[ord("Q")] = 4, 2
NAMES = pa.array(["M", "L", "C", "Q", "Z"])


def parsed_paths(df: DataFrame, d: str = "d", out: str = "commands") -> DataFrame:
    """``df`` with its path data ``d`` as absolute commands ``out``, as of ``parse_path``."""
    others = [c for c in df.columns if c not in (d, out)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), commands(batch.column(d))], [*others, out])

    return df.select(*others, d).mapInArrow(run, f"{kinds}, `{out}` array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>")


def _numbers(texts: pa.Array) -> np.ndarray:
    try:
        return texts.cast(pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # out of a double's range
        return np.array([float(t) for t in texts.to_pylist()], float)


def commands(column: pa.Array) -> pa.Array:
    """The commands of each path of a text column; null for null."""
    texts = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\0", " ").to_pylist()
    tokens = pa.array(TOKENS.findall("\0".join([*texts, ""])), pa.large_string())
    _, offsets, data = tokens.buffers()
    first = np.frombuffer(data, np.uint8)[np.frombuffer(offsets, np.int64)[: len(tokens)]].astype(int) if len(tokens) else np.zeros(0, int)
    letter = (first >= 65) | (first == 0)
    number = _numbers(tokens.filter(pa.array(~letter)))
    # A command's numbers run up to the next letter or mark; those before a path's first command belong to none.
    at = np.flatnonzero(letter)
    start = at - np.arange(len(at))
    n = np.diff(start, append=len(number))
    code, path = first[at], np.cumsum(first[at] == 0)
    some = code != 0
    code, path, start, n = code[some], path[some], start[some], n[some]
    kind = code & 0xDF
    of = lambda kinds, v: np.isin(v, [ord(k) for k in kinds])
    count = np.where(kind == ord("Z"), 1, np.where(of("STA", kind), 0, -(-n // ARITY[kind])))
    owner = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    k, relative, base, bound = kind[owner], (code >= 97)[owner], (start[owner] + i * ARITY[kind[owner]]), (start + n)[owner]
    padded = np.append(number, 0.0)

    def operand(place: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ``place`` of each command, and where there is none."""
        where = base + place
        missing = ~wanted | (where >= bound)
        return padded[np.where(missing, len(number), where)], missing

    curve, cubic, drawn = of("CQ", k), k == ord("C"), k != ord("Z")
    stays = {"x": of("VZ", k), "y": of("HZ", k)}
    ends = {"x": operand(LAST[k], ~stays["x"]), "y": operand(np.where(k == ord("V"), 0, LAST[k] + 1), ~stays["y"])}
    sizes = np.bincount(path[owner], minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    # Paths by falling length, so that those with a command at each step come first.
    order = np.argsort(-sizes, kind="stable")
    longest_first = sizes[order]
    fields = {}
    for axis, controls in (("x", (0, 2)), ("y", (1, 3))):
        end, none = ends[axis]
        now, lost = np.zeros(len(texts)), np.zeros(len(texts), bool)
        before, before_lost, after, after_lost = np.empty(len(k)), np.empty(len(k), bool), np.empty(len(k)), np.empty(len(k), bool)
        for step in range(int(longest_first[0]) if len(texts) else 0):
            live = order[: np.searchsorted(-longest_first, -step, "left")]
            j = begins[live] + step
            b, gone = np.where(relative[j], now[live], 0.0), relative[j] & lost[live]
            before[j], before_lost[j] = b, gone
            stay = stays[axis][j]
            now[live] = np.where(stay, now[live], b + end[j])
            lost[live] = np.where(stay, lost[live], gone | none[j])
            after[j], after_lost[j] = now[live], lost[live]
        fields[axis] = pa.array(after, mask=after_lost | ~drawn)
        for name, place, wanted in ((axis + "1", controls[0], curve), (axis + "2", controls[1], cubic)):
            value, missing = operand(np.full(len(k), place), wanted)
            fields[name] = pa.array(before + value, mask=missing | before_lost)
    name = np.where((k == ord("M")) & (i == 0), 0, np.where(cubic, 2, np.where(curve, 3, np.where(drawn, 1, 4))))
    names = [part.split(" ")[0] for part in POINT.split(", ")]
    points = pa.StructArray.from_arrays([NAMES.take(pa.array(name)), *(fields[f] for f in names[1:])], names)
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(k)).astype(np.int32)), points, mask=column.is_null())
