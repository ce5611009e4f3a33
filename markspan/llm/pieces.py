"""SentencePiece encoding and decoding for merge-type vocabularies.

Merging takes the adjacent pair of symbols whose joined piece scores best, the leftmost of equals, until no pair is a
piece. No piece crosses the start of a run of word marks, nor holds a symbol that is in no longer piece, so a text falls
apart into segments with agendas of their own. Segments of equal length are merged side by side: each round takes the
first entry of every agenda. Long segments keep theirs in a heap. What a worker encodes for the first time is checked
against the sentencepiece library, and a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from markspan.llm.wordcache import WordCache

MARK = "▁"  # stands for a space
SIDE_BY_SIDE = 48  # symbols of a segment; longer ones are merged by heap
NORMAL, USER_DEFINED = 1, 4  # piece types that merging may form


class Vocabulary:
    """The pieces of a model file and every way to join two of them into a third."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("expected a merge-type model with identity normalisation, a leading mark and kept white space")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        scores = np.array([p.score for p in proto.pieces], dtype=np.float32)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses the start of a word")
        single = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.pieces.items():
            if len(p) == 1:
                single[ord(p)] = i
        self.single = single
        # Symbols of two halves are ids; every rank is the place of a piece by score, best first, equal scores sharing it.
        ranks = {s: k for k, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        pairs = {}
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = self.pieces.get(p[:cut]), self.pieces.get(p[cut:])
                if a is not None and b is not None:
                    pairs[(a, b)] = (ranks[float(scores[i])], i)
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        values = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)
        self.keys, self.ranks, self.joins = keys[order], values[order, 0], values[order, 1].astype(np.int32)
        longer = {c for p in self.pieces if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in longer)
        cut_at = re.escape(self.alone)
        self.segments = re.compile(f"{MARK}+[^{MARK}{cut_at}]*|[{cut_at}]|[^{MARK}{cut_at}]+" if cut_at else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of pairs; a rank past all others where a pair is no piece."""
        wanted = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[at], np.iinfo(np.int64).max), self.joins[at]

    def by_rounds(self, words: list[str]) -> list[list[int]]:
        """Symbols of words of one length. A symbol that is no piece is -1 minus its code point."""
        n = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, -1).astype(np.int64)
        ids = self.single[points]
        symbols = np.where(ids >= 0, ids, (-1 - points).astype(np.int32)).astype(np.int32)
        rows = np.arange(n)
        out: list[list[int]] = [[]] * n
        ranks, joins = self.look_up(symbols[:, :-1], symbols[:, 1:])
        none = np.iinfo(np.int64).max
        while len(rows):
            width = symbols.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            live = ranks[np.arange(len(rows)), best] < none if width > 1 else np.zeros(len(rows), dtype=bool)
            for row, done in zip(rows[~live].tolist(), symbols[~live].tolist(), strict=True):
                out[row] = done
            rows, symbols, ranks, joins, best = rows[live], symbols[live], ranks[live], joins[live], best[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            symbols[each, best] = joins[each, best]
            keep = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            symbols = np.take_along_axis(symbols, keep, axis=1)
            keep = np.arange(width - 2) + (np.arange(width - 2) >= best[:, None])
            ranks, joins = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(joins, keep, axis=1)
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 2)
                r, s = each[ok], side[ok]
                ranks[r, s], joins[r, s] = self.look_up(symbols[r, s], symbols[r, s + 1])
        return out

    def by_heap(self, word: str) -> list[int]:
        """Symbols of one word of any length, in time about linear in it."""
        symbols = [int(self.single[ord(c)]) if self.single[ord(c)] >= 0 else -1 - ord(c) for c in word]
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        alive = [True] * len(symbols)
        agenda: list[tuple[int, int, int, int]] = []

        def propose(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(symbols):
                found = self.pairs.get((symbols[left], symbols[right]))
                if found:
                    heapq.heappush(agenda, (found[0], left, symbols[left], symbols[right]))

        for k in range(len(symbols) - 1):
            propose(k)
        while agenda:
            _, left, a, b = heapq.heappop(agenda)
            right = after[left]
            if not alive[left] or symbols[left] != a or right >= len(symbols) or symbols[right] != b:
                continue
            symbols[left], alive[right] = self.pairs[(a, b)][1], False
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            if before[left] >= 0:
                propose(before[left])
            propose(left)
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def ids(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; what is no piece goes byte by byte, or is unknown where the model has no byte pieces."""
        if min(symbols) >= 0:
            return symbols
        out = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - s).encode())
            else:
                out.append(self.unknown)
        return out

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments as little-endian unsigned 32-bit integers, checked against the library."""
        found: dict[str, list[int]] = {}
        groups = defaultdict(list)
        for s in segments:
            groups[len(s)].append(s)
        for length, words in groups.items():
            if length > SIDE_BY_SIDE:
                found.update((w, self.by_heap(w)) for w in words)
            else:
                found.update(zip(words, self.by_rounds(words), strict=True))
        mine = [self.ids(found[s]) for s in segments]
        self.check(segments, mine)
        return [np.array(x, dtype="<u4").tobytes() for x in mine]

    def check(self, segments: list[str], mine: list[list[int]]) -> None:
        """Compare with the library, which marks the start of what it encodes: a segment's first mark is taken for that, a
        segment without mark stands behind a symbol that starts segments. A lone mark can't be asked for."""
        lead = self.alone[:1]
        texts = [s[1:].replace(MARK, " ") if s.startswith(MARK) else lead + s for s in segments]
        before = self.library.encode(lead) if lead else []
        theirs = self.library.encode(texts, num_threads=1)
        for s, a, b in zip(segments, mine, theirs, strict=True):
            if s != MARK and (a if s.startswith(MARK) else before + a) != b:
                raise AssertionError(f"the library encodes {s!r} as {b}, not {a}")


class Encoder:
    """Whole texts to ids, with the words of earlier texts remembered within bounds."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.cache = WordCache(self._segments, self.vocabulary.encode_segments)

    def _segments(self, text: str) -> list[str]:
        return self.vocabulary.segments(MARK + text.replace(" ", MARK)) if text else []

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, without begin and end."""
        return (np.frombuffer(x, dtype="<u4") for x in self.cache.encode_all(texts))

    def decode(self, ids: list[int]) -> str:
        return self.vocabulary.library.decode(ids)


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder per worker and model."""
    name = hashlib.sha256(model).digest()
    if name not in _encoders:
        _encoders[name] = Encoder(model)
    return _encoders[name]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(model: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        first, last = np.array([enc.vocabulary.bos], dtype="<u4"), np.array([enc.vocabulary.eos], dtype="<u4")
        for batch in batches:
            counts, coded, read = [], [], []
            for body in enc.encode_all(t.as_py() for t in batch.column("text")):
                ids = np.concatenate([first, body, last])
                counts.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                read.append(hashlib.sha256(enc.decode(ids.tolist()).encode()).hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(read, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, ids with begin and end, read back by decode.

    A null text reads as empty and gives the two ids alone. Rows stay where they are read; nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_digests(model), ENCODED)


def _tokens(model: bytes, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            ids = [x.astype(np.int32) for x in enc.encode_all(t.as_py() for t in batch.column("text"))]
            yield batch.append_column(name, pa.array(ids, pa.list_(pa.int32())))

    return run


def encode(docs: DataFrame, model: bytes, name: str = "ids") -> DataFrame:
    """Adds the ids of `text` (none for null or empty) as column `name`, replacing a column of that name."""
    kept = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_tokens(model, name), f"{schema}, `{name}` array<int>")
