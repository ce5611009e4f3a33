"""Repair of the structure of conversations by a stream that carries a dynamic programme.

Rows are dealt by conversation and sorted by turn; `mapInPandas` then reads each partition as one stream, and the state of the
programme passes from batch to batch. A state is how far the repaired sequence of roles has come; of each state the cheapest way
so far is held with its rank among the states (which decides between equal costs) and the running digest of its repaired text.
So no text is held beyond its row. One byte a row and state says how each way went; those bytes leave memory for files in the
shared folder when a conversation is a giant, and are read back from its end to spell the audit.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.session import new_path

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3  # added to a row that is cut short and stays
SPILL_BYTES = 16 << 20  # of backpointers that a task holds in memory

# States: nothing yet, after the system's turn, after a user's, after an assistant's. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_TO_END = (0, 2, 1, 0)  # turns to insert before the sequence may end
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_EDITS = KEEP + REROLE + DELETE


def _inserted(state: int, times: int) -> list[int]:
    """The states that inserted turns lead through."""
    out = []
    for _ in range(times):
        state = _NEXT[state]
        out.append(state)
    return out


@dataclass
class Way:
    cost: int
    rank: int
    digest: hashlib._Hash


@dataclass
class Pointers:
    """Four bytes a row, spilled in files below `folder` beyond `bound` and read back from the end."""

    folder: str
    bound: int
    held: bytearray = field(default_factory=bytearray)
    files: list[str] = field(default_factory=list)

    def add(self, row: bytes) -> None:
        self.held += row
        if len(self.held) >= self.bound:
            store, place = fs.FileSystem.from_uri(self.folder)
            store.create_dir(place, recursive=True)
            self.files.append(f"{place}/{uuid.uuid4().hex}")
            with store.open_output_stream(self.files[-1], compression=None) as out:
                out.write(self.held)
            self.held = bytearray()

    def backward(self) -> Iterator[bytes]:
        yield from self._rows(self.held)
        if self.files:
            store, _ = fs.FileSystem.from_uri(self.folder)
            while self.files:
                name = self.files.pop()
                with store.open_input_stream(name, compression=None) as file:
                    data = file.read()
                yield from self._rows(data)
                store.delete_file(name)

    @staticmethod
    def _rows(data: bytes | bytearray) -> Iterator[bytes]:
        for at in range(len(data) - 4, -1, -4):
            yield data[at : at + 4]


def _written(digest: hashlib._Hash, first: bool, role: str, text: str) -> None:
    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))


class Repair:
    """One conversation, row by row."""

    def __init__(self, folder: str, bound: int = SPILL_BYTES) -> None:
        self.ways: dict[int, Way] = {START: Way(0, 0, hashlib.sha256())}
        self.pointers = Pointers(folder, bound)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.before: str | None = None
        self.turns: list[int] = []  # smallest, largest, how many different
        self.turn: str | None = None

    def add(self, turn: str | None, role: str, text: str, again: bool) -> None:
        """The next row; `again` where its role and text have come before."""
        if turn is not None and turn != self.turn:
            number = int(turn)
            self.turns = [self.turns[0], number, self.turns[2] + 1] if self.turns else [number, number, 1]
            self.turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        shown = text.rstrip(BLANKS)
        fault = "blank" if not shown else "duplicate" if again else "truncated" if shown[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        self._step(initial, role, text, fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)

    def _step(self, initial: str, role: str, text: str, must_go: bool, extra: int) -> None:
        best: dict[int, tuple] = {}
        for origin, way in self.ways.items():
            for times in range(3):
                state = _inserted(origin, times)[-1] if times else origin
                base = way.cost + COST[INSERT] * times
                choices = [(DELETE, state, base + COST[DELETE])]
                if not must_go:
                    if initial in _KEPT[state]:
                        choices.append((KEEP, _KEPT[state][initial], base + extra))
                    choices.append((REROLE, _NEXT[state], base + COST[REROLE] + extra))
                for edit, target, cost in choices:
                    key = (cost, way.rank, INSERT * times + edit, origin)
                    if target not in best or key < best[target]:
                        best[target] = key
        pointers = bytearray(b"\xff" * 4)
        ranks = {key[1:3]: place for place, key in enumerate(sorted(best.values(), key=lambda k: k[1:3]))}
        ways = {}
        for target, (cost, rank, edits, origin) in best.items():
            pointers[target] = origin << 4 | (len(edits) - 1) << 2 | _EDITS.index(edits[-1])
            digest = self._extended(origin, edits, role if edits[-1] == KEEP else _NAMES.get(target, ""), text)
            ways[target] = Way(cost, ranks[rank, edits], digest)
        self.ways = ways
        self.pointers.add(bytes(pointers))

    def _extended(self, state: int, edits: str, role: str, text: str) -> hashlib._Hash:
        digest = self.ways[state].digest
        if edits == DELETE:
            return digest  # shared; nothing writes into a digest without copying it
        digest = digest.copy()
        first = state == START
        for state in _inserted(state, len(edits) - 1):
            _written(digest, first, _NAMES[state], "")
            first = False
        if edits[-1] != DELETE:
            _written(digest, first, role, text)
        return digest

    def result(self) -> dict:
        cost, _, state = min((way.cost + COST[INSERT] * _TO_END[state], way.rank, state) for state, way in self.ways.items())
        end = INSERT * _TO_END[state]
        digest = self._extended(state, end + DELETE, "", "")
        spelled = [end]
        for row in self.pointers.backward():
            code = row[state]
            spelled.append(INSERT * (code >> 2 & 3) + _EDITS[code & 3])
            state = code >> 4
        spelled.reverse()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": "".join(spelled), "repaired_sha256": digest.hexdigest()}


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(folder: str, bound: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv: str | None = None
        repair: Repair | None = None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if repair is None or row.conv != conv:
                    if repair is not None:
                        done.append({"conv": conv, **repair.result()})
                    conv, repair = row.conv, Repair(folder, bound)
                for copy in range(row.copies):
                    repair.add(row.turn, row.role, row.text, copy > 0 or not row.first)
            if done:
                yield pd.DataFrame(done)
        if repair is not None:
            yield pd.DataFrame([{"conv": conv, **repair.result()}])

    return run


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations damaged by crc32(`conv_id:turn`) % 20: 0 drops the row (no copies), 1
    empties its text, 2 takes `.!?` from it, 3 repeats it, 4 makes its role user. Nulls read as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id",
        F.when(kind > 0, F.col("turn")).alias("turn"),
        F.when(kind == 4, F.lit("user")).when(kind > 0, F.coalesce("role", space)).otherwise(space).alias("role"),
        F.when(kind == 2, F.translate(text, ".!?", "")).when(kind > 1, text).otherwise(F.lit("")).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def sorted_rows(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copies, first) of each conversation in one partition, sorted by turn, role and text, nulls
    first. Equal rows are one with a count; `first` where no earlier row has the role and text."""
    conv = F.col("conv_id").cast("string").alias("conv")
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select(conv, F.col("turn").cast("long").alias("number"), role, text, copies.alias("copies"))
    rows = rows.groupBy("conv", "number", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("said")
    # Only what is said at several turns has to be looked up.
    earliest = F.when(F.bool_or(F.col("number").isNull()), F.lit(None)).otherwise(F.min("number")).alias("earliest")
    again = rows.filter("copies > 0").groupBy(F.col("conv").alias("__conv"), said.alias("__said")).agg(earliest, F.count(F.lit(1)).alias("times")).filter("times > 1")
    told = rows.withColumn("said", said).join(again, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("said") == F.col("__said")), "left")
    first = F.col("times").isNull() | F.col("number").eqNullSafe(F.col("earliest"))
    dealt = told.select("conv", "number", F.col("number").cast("string").alias("turn"), "role", "text", "copies", first.alias("first"))
    return dealt.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("number"), "role", "text")


def repair_reports(turns: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text[, copies]): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    The cheapest edits (Keep, Rerole, Delete, Insert) that give the roles `(s?(ua)+)?`; of equally cheap ones the audit that is
    least in ASCII. Blank rows and repeats go; a row that ends without `.!?` costs more where it stays. Null roles and texts read
    as one space; null turns come first, and rows of one turn are ordered by role and text. Rows that repeat count each; null
    ids are one conversation; `copies` 0 keeps the id of a conversation without rows. Further columns are ignored, texts may be of any length.
    No rows: no reports. A conversation is one stream, so it is one task's, in memory that does not grow with its texts; its audit is one value."""
    folder = re.sub("^file:/+", "/", new_path(turns.sparkSession, "pointers"))
    rows = sorted_rows(turns).select("conv", "turn", "role", "text", "copies", "first")
    told = rows.mapInPandas(_reports(folder, spill_bytes), REPORT)
    return told.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), *[c for c in told.columns if c != "conv"])


REPAIRED = "conv string, place long, turn string, role string, text string, edit string"


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv: object = batches  # no conversation yet
    audit, at, place, state = "", 0, 0, START
    for batch in batches:
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, place, state
            while at < len(audit) and audit[at] == INSERT:
                at, place, state = at + 1, place + 1, _NEXT[state]
                out.append((conv, place, None, _NAMES[state], "", INSERT))

        for row in batch.itertuples(index=False):
            if row.audit is not None:
                conv, audit, at, place, state = row.conv, row.audit, 0, 0, START
                inserts()
                continue
            for _ in range(row.copies):
                edit = audit[at]
                at += 1
                if edit != DELETE:
                    state, place = _KEPT[state][row.role[:1]] if edit == KEEP else _NEXT[state], place + 1
                    out.append((conv, place, row.turn, row.role if edit == KEEP else _NAMES[state], row.text, edit))
                inserts()
        yield pd.DataFrame(out, columns=["conv", "place", "turn", "role", "text", "edit"])


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), turn (null where inserted), role, text, edit.

    A conversation's audit travels ahead of its rows, as a row of its own."""
    columns = ["conv", "number", "turn", "role", "text", "copies", "audit"]
    rows = sorted_rows(turns).withColumn("audit", F.lit(None).cast("string")).select(*columns, F.lit(1).alias("kind"))
    ahead = reports.select(F.col("conv_id").cast("string").alias("conv"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit", F.lit(0).alias("kind"))
    both = ahead.unionByName(rows).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "kind", F.asc_nulls_first("number"), "role", "text")
    out = both.select("conv", "turn", "role", "text", "copies", "audit").mapInPandas(_applied, REPAIRED)
    return out.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), "place", F.col("turn").cast("long").alias("turn"), "role", "text", "edit")
