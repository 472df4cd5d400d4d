"""The way of a drawing session through its letters, folded over its events.

Events are dealt by session and sorted inside the partitions; one pass carries a session's letter, the set of drawn letters
as bits, and whether it is over, so a session of any length takes no more than a batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.letters import LETTERS

STEPS = "session_id long, seq long, letter int, drawn long, over boolean"
N = len(LETTERS)


def pick(session: int, seq: int, drawn: int) -> int | None:
    """One of the letters that are not drawn, by a hash of the session and the event; None if all are."""
    left = [k for k in range(N) if not drawn >> k & 1]
    return left[int(hashlib.md5(f"{session}:{seq}".encode()).hexdigest()[:8], 16) % len(left)] if left else None


def moved(state: tuple[int, int, bool], session: int, seq: int, action: str, to: int | None, inked: bool) -> tuple[int, int, bool]:
    """(letter, drawn, over) after an event: "next" saves what is drawn and goes to a letter not drawn yet, or ends if all
    are, and does nothing on a blank canvas; "go" saves and goes to a letter; "skip" goes to the letter after this one without saving, and ends after
    the last; "finish" saves and ends. Nothing moves once it is over."""
    letter, drawn, over = state
    if over:
        return state
    saved = drawn | (1 << letter) if inked else drawn
    if action == "next" and inked:
        after = pick(session, seq, saved)
        return (letter, saved, True) if after is None else (after, saved, False)
    if action == "go" and to is not None and 0 <= to < N and to != letter:
        return to, saved, False
    if action == "skip":
        return (letter, drawn, True) if letter == N - 1 else (letter + 1, drawn, False)
    if action == "finish":
        return letter, saved, True
    return state


def navigated(events: DataFrame) -> DataFrame:
    """(session_id, seq, letter, drawn, over) after each of ``events`` (session_id, seq, action, to, inked); a session begins at the first letter with none drawn.

    ``drawn`` holds a bit for each letter. Rows without a session or a sequence number are left out; a null action moves nothing; a null ``inked`` is a blank canvas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, (0, 0, False)
        for batch in batches:
            rows = []
            for own, seq, action, to, inked in zip(*(c.to_pylist() for c in batch.columns)):
                if own != session:
                    session, state = own, (0, 0, False)
                state = moved(state, session, seq, action, to, bool(inked))
                rows.append((own, seq, *state))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["session_id", "seq", "letter", "drawn", "over"])

    rows = events.where("session_id is not null and seq is not null").select("session_id", "seq", "action", F.col("to").cast("int"), "inked")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "action", "to", "inked").mapInArrow(run, STEPS)
