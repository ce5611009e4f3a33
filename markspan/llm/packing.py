"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Each task streams its documents: full windows are cut off at once, what remains is cut into pieces that gather until they
fill a fixed number of windows. Differencing then deals the pieces out: every piece starts as a partition with one filled
window; the two partitions of the largest imbalance are merged again and again, the fullest windows of one with the
emptiest of the other. If a window of the result is over its capacity, one more window is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markspan.llm.bpe import Merges, gathered
from markspan.llm.common import giving_back


@dataclass(frozen=True)
class Windows:
    """`group` is the number of windows filled at a time, `fill` the share of their room that a group takes before it is dealt
    out; the rest is room for differencing to be uneven. Pieces are cut to at most `largest` ids; the last of a group are cut
    to `fine`, in turn, one for each window, so that they even out what the larger ones leave."""

    capacity: int = 2048
    largest: int = 512
    group: int = 96
    fill: float = 0.997
    fine: tuple[int, ...] = (48, 12, 3)
    end_id: int = 1


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """The items of each of `ways` sets with near-equal sums."""
    # A partition lists its filled windows, fullest first, as (sum, items); items are nested pairs until the end.
    agenda = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(agenda)
    if ways == 1:
        return [list(range(len(sizes)))]
    while len(agenda) > 1:
        _, number, a = heapq.heappop(agenda)
        _, _, b = heapq.heappop(agenda)
        alone = max(0, ways - len(b))  # windows of a that meet an empty one of b
        met = zip(a[alone:], reversed(b[ways - len(a) :] if len(a) + len(b) > ways else []), strict=True)
        merged = a[:alone] + b[: ways - len(a)] + [(x + y, (i, j)) for (x, i), (y, j) in met]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(agenda, (-spread, number, merged))
    return [_flat(items) for _, items in agenda[0][2]] if agenda else []


def _flat(nested) -> list[int]:
    out, stack = [], [nested]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the sum upward, for which differencing keeps every window within its capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        ways += 1


CHARS = 1 << 20  # of texts that are taken together


class WordIds:
    """Ids of texts by a tokenizer whose words end at blanks and line ends, with parts of earlier words remembered within bounds."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.merges = Merges(tokenizer, self._encode)

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """The library takes words by the list, which costs it less than one by one."""
        lists = [words[k : k + 64] for k in range(0, len(words), 64)]
        for part, coded in zip(lists, self.tokenizer.encode_batch(lists, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(coded.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            yield from (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        told = words.flatten().dictionary_encode()
        ids, begins, counts = self.merges.encoded(told.dictionary)
        at = told.indices.to_numpy()
        ids = gathered(ids, begins[at], counts[at])
        bounds = np.concatenate([[0], np.cumsum(counts[at])])[words.offsets.to_numpy()].tolist()
        return (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null reads as empty."""
        waiting, chars = [], 0
        for t in texts:
            waiting.append(t or "")
            chars += len(waiting[-1])
            if chars >= CHARS:
                yield from self._together(waiting)
                waiting, chars = [], 0
        if waiting:
            yield from self._together(waiting)


_coders: dict[bytes, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """One for each worker and tokenizer, so that words stay known from task to task."""
    name = hashlib.sha256(tokenizer.encode()).digest()
    if name not in _coders:
        _coders[name] = WordIds(tokenizer)
    return _coders[name]


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packed(tokenizer: str, cfg: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        first = TaskContext.get().partitionId() << 40
        state = {"next": first, "held": 0}
        pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        rows: list[tuple] = []

        def place(window: list[tuple]) -> None:
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), total, state["next"], offset, ids.tobytes()))
                offset += len(ids)
            state["next"] += 1

        def deal() -> None:
            for window in near_equal_windows([len(p[2]) for p in pieces], cfg.capacity):
                place([pieces[i] for i in sorted(window)])
            pieces.clear()
            state["held"] = 0

        room = int(cfg.group * cfg.capacity * cfg.fill)
        def largest_now(left: int) -> int:
            kept = 0
            for size in reversed(cfg.fine):
                kept += size * cfg.group
                if left <= kept:
                    return min(size, left)
            return min(cfg.largest, left - kept)

        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            for doc, body in zip(batch.column("doc_id").to_pylist(), words.encode_all(texts), strict=True):
                ids = np.append(body, np.array([cfg.end_id], dtype="<u4"))
                total = len(ids)
                full = total - total % cfg.capacity
                for start in range(0, full, cfg.capacity):
                    place([(doc, start, ids[start : start + cfg.capacity], total)])
                start = full
                while start < total:
                    size = min(total - start, largest_now(room - state["held"]))
                    pieces.append((doc, start, ids[start : start + size], total))
                    state["held"] += size
                    start += size
                    if state["held"] == room:
                        deal()
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows.clear()
        if pieces:
            deal()
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, cfg: Windows | None = None) -> DataFrame:
    """The pieces of all documents in windows: doc_id, start (ids of the document before it), length, doc_tokens,
    sequence_id, offset (place in the sequence, without gaps from 0), ids (little-endian unsigned 32-bit integers).

    `tokenizer` is the JSON text of a tokenizer. Each document is its ids and the end id, so a null or empty text gives one
    piece of one id. Rows are packed where they are read, without a shuffle: a task holds one group of windows. Rows that
    repeat are packed each; a null doc_id stays null. Sequence ids are unique over all tasks and the same when a task is
    run again; only the last group of a task may leave a window part empty."""
    return docs.select("doc_id", "text").mapInArrow(giving_back(_packed(tokenizer, cfg or Windows())), PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
