"""Conversations as training texts in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans. Every window begins with the system turn and, after the first, with
as many of the last turns before it as the history budget holds; these repeated turns stand outside the loss mask, which
holds each assistant text once. A window is text and the spans of its mask; reading it back gives the turns again.

Template: <s>, then for each turn "<turn:role>" text "</turn>", then </s>. Inside texts a backslash follows each "<" and "[",
and is doubled itself, so that no control string stands in a text; role names are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.packing import word_ids

BEGIN, END, CLOSE = "<s>", "</s>", "</turn>"
FRAME = 6  # tokens counted for the marks of a turn
TURNS = 1024  # turn numbers of a part; a longer conversation is formatted part by part


@dataclass(frozen=True)
class Budget:
    """Tokens of a window and, of those, of repeated history. A turn above the budget has a window of its own."""

    window: int = 2048
    history: int = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


_MARK = re.compile(r"\\\\|<\\|\[\\")


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[0][0], text)


def open_mark(role: str) -> str:
    return f"<turn:{quote(role, safe='')}>"


_TURN = re.compile(r"<turn:([^>]*)>(.*?)</turn>", re.DOTALL)


def spans(tokens: np.ndarray, budget: Budget, lead: int) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window over turns of these sizes; `lead` is the system turn's."""
    sums = np.concatenate([[0], np.cumsum(tokens + FRAME)])
    out, start = [], 0
    while start < len(tokens):
        back = start
        if start:
            back = min(start, int(np.searchsorted(sums, sums[start] - budget.history, "left")))
        room = budget.window - (lead + FRAME if lead and start else 0)
        end = int(np.searchsorted(sums, sums[back] + room, "right")) - 1
        if end <= start:  # without history, and at least one turn
            back = start
            end = max(start + 1, int(np.searchsorted(sums, sums[start] + room, "right")) - 1)
        end = min(end, len(tokens))
        out.append((back, start, end))
        start = end
    return out


WINDOWS = (
    "conv_id long, part long, window int, repeated int, n_turns int, text string, loss array<struct<start:int,end:int>>"
)


def _formatted(tokenizer: str, budget: Budget) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        rows: list[tuple] = []

        def put(key: tuple, turns: list[tuple[str, str, bool]]) -> None:
            sizes = np.array([len(x) for x in words.encode_all(t for _, t, _ in turns)], dtype=np.int64)
            # A system turn is carried from an earlier part, or is the first one here.
            system = next((k for k, t in enumerate(turns) if t[0] == "system"), None)
            carried = system is not None and turns[system][2]
            body = [k for k in range(len(turns)) if not (carried and k == system)]
            for n, (back, start, end) in enumerate(spans(sizes[body], budget, int(sizes[system]) if system is not None else 0)):
                again = [body[k] for k in range(back, start)]
                if system is not None and (carried or system < body[start]) and system not in again:
                    again.insert(0, system)
                text, loss = BEGIN, []
                for k in again + [body[k] for k in range(start, end)]:
                    role, said, _ = turns[k]
                    text += open_mark(role)
                    shown = escape(said)
                    if role == "assistant" and k not in again:
                        loss.append({"start": len(text), "end": len(text) + len(shown)})
                    text += shown + CLOSE
                rows.append((*key, n, len(again), len(again) + end - start, text + END, loss))

        held: list[tuple[str, str, bool]] = []
        at: tuple | None = None
        names = [f.split(" ")[0] for f in WINDOWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "carried")]
            for conv, part, role, text, carried in zip(*columns, strict=True):
                if at is not None and at != (conv, part):
                    put(at, held)
                    held = []
                at = (conv, part)
                held.append((role or "", text or "", carried))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows.clear()
        if at is not None:
            put(at, held)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def format_windows(turns: DataFrame, tokenizer: str, budget: Budget | None = None) -> DataFrame:
    """The windows of all conversations of (conv_id, turn, role, text): conv_id, part, window (from 0 in a part), repeated
    (leading turns that are repeats), n_turns, text, loss (spans of the mask in code points, end exclusive).

    Null roles and texts read as empty; turns go by number (null first), then role, then text, so repeated rows are all
    kept; rows without conv_id are one conversation. A part is TURNS turn numbers, and a conversation of any length is spread
    over its parts; later parts get its system turn (the first by number) as a repeat. Empty input gives no rows."""
    part = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1)).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", part.alias("part"))
    systems = rows.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), "part")).alias("s"))
    parts = rows.select("conv_id", "part").distinct()
    later = parts.join(systems, parts["conv_id"].eqNullSafe(systems["conv_id"])).filter(F.col("part") > F.col("s.part"))
    carried = later.select(parts["conv_id"], F.lit(None).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("s.text").alias("text"), "part", F.lit(True).alias("carried"))
    every = rows.withColumn("carried", F.lit(False)).unionByName(carried)
    keys = ["conv_id", "part"]
    laid = every.repartition(*keys).sortWithinPartitions(*keys, F.col("carried").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    return laid.select("conv_id", "part", "role", "text", "carried").mapInArrow(_formatted(tokenizer, budget or Budget()), WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window."""
    if not (text.startswith(BEGIN) and text.endswith(END)):
        raise ValueError("not a window")
    body, out, at = text[len(BEGIN) : -len(END)], [], 0
    for m in _TURN.finditer(body):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(body):
        raise ValueError("text after the last turn")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict = {}
    done: list[tuple] = []

    def close() -> None:
        if state:
            done.append((state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["text"]))

    def flush() -> pa.RecordBatch:
        names = [f.split(" ")[0] for f in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=names)
        done.clear()
        return out

    for batch in batches:
        for conv, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "repeated", "text", "loss")), strict=True):
            if not state or state["conv"] != conv:
                close()
                state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "text": 0}
            for role, said in read_turns(text)[repeated:]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["text"] += len(text)
        yield flush()
    close()
    yield flush()


def window_digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say when they are read back, streamed in order: one row per conversation."""
    keys = ["conv_id", "part", "window"]
    laid = windows.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "repeated", "text", "loss")
    return laid.mapInArrow(_read_back, DIGESTS)
