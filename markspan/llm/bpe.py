"""Byte-pair merges of many distinct words side by side.

For tokenizers that lower-case, split words into letters, single digits and other signs, and merge the bytes of each part by rank with a mark
at its end. Words of plain and Latin-1 letters are taken apart here; the tokenizer's library encodes all others. Words, parts and ids stay in
arrays from end to end; Python objects are made only of words with an apostrophe and of those that the library gets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What is taken apart here: printable ASCII and the letters and two signs of Latin-1, which neither compose nor need a table.
_SIMPLE = re.compile(r"[\x21-\x7e\xc0-\xff]+").fullmatch
_LETTERS = r"a-z\xdf-\xf6\xf8-\xff"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+").findall
# The normaliser and the pattern for which the above holds.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"
LONGEST = 32  # characters of a word that is taken apart here
# Without apostrophes and the two signs a part ends where the kind of byte changes, and at each digit.
_PLAIN = rf"^[!-&(-~\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{ff}}]{{1,{LONGEST}}}$"
_DIGIT, _OTHER = 1, 2
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_KIND[0x30:0x3A] = _DIGIT
PARTS_KNOWN = 200_000  # parts, and words of the library, until those that came only once are forgotten: about 50 bytes each
WORDS_AT_ONCE = 65_536

Coded = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, and where each item's begin and how many they are


def gathered(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of the items in turn."""
    ends = np.cumsum(counts)
    return ids[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and where each begins."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


class Known:
    """The ids of strings that have come before, within a bound; `learn` gives those of new ones, in their order."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.learn = learn
        self.strings = pa.array([], pa.string())
        self.ids, self.counts = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.again = np.zeros(0, dtype=bool)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again)
        keep = keep if 2 * len(keep) <= PARTS_KNOWN else keep[:0]
        self.ids = gathered(self.ids, np.cumsum(self.counts)[keep] - self.counts[keep], self.counts[keep])
        self.strings, self.counts, self.again = self.strings.take(pa.array(keep)), self.counts[keep], np.zeros(len(keep), dtype=bool)

    def look_up(self, strings: pa.Array) -> Coded:
        """Of distinct strings."""
        if len(self.strings) > PARTS_KNOWN:
            self._forget()
        found = pc.index_in(strings, value_set=self.strings)
        fresh = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.again[at[~fresh]] = True
        new = strings.filter(pa.array(fresh))
        if len(new):
            at[fresh] = len(self.strings) + np.arange(len(new))
            ids, counts = self.learn(new)
            self.strings = pa.concat_arrays([self.strings, new])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.again = np.concatenate([self.again, np.zeros(len(new), dtype=bool)])
        return self.ids, (np.cumsum(self.counts) - self.counts)[at], self.counts[at]


def _byte_names() -> list[str]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Ids of words as the library gives them; `whole` encodes what is not taken apart here."""

    def __init__(self, tokenizer: str, whole: Callable[[list[str]], Iterator[bytes]]) -> None:
        told = json.loads(tokenizer)
        model = told["model"]
        splits = told["pre_tokenizer"].get("pretokenizers", [])
        self.known = told["normalizer"].get("normalizers") == NORMAL and [s.get("pattern") for s in splits] == [{"Regex": PATTERN}, None] and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
        self.whole = whole
        self.words, self.parts = Known(self._by_library), Known(self._by_merging)
        if not self.known:
            return
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        joins = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.joins = keys[order], order.astype(np.int64), joins[order]
        names = _byte_names()
        self.inner, self.last = (np.array([vocab[c + end] for c in names], dtype=np.int64) for end in ("", "</w>"))
        # Of each two bytes, the second within a part or at its end.
        self.first = [self._look_up(self.inner[:, None], second) for second in (self.inner, self.last)]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], len(self.keys)), self.joins[at]

    def _merged(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids of each) of parts of one length: each round merges every part's best pair, the leftmost of equal ones."""
        symbols = self.inner[raw]
        symbols[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(raw))
        none = len(self.keys)
        ranks, joins = (self.first[0][k][raw[:, :-1], raw[:, 1:]] for k in (0, 1))
        if raw.shape[1] > 1:
            ranks[:, -1], joins[:, -1] = (self.first[1][k][raw[:, -2], raw[:, -1]] for k in (0, 1))
        while len(rows):
            width = symbols.shape[1]
            each = np.arange(len(rows))
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            live = ranks[each, best] < none if width > 1 else np.zeros(len(rows), dtype=bool)
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, ranks, joins, best = rows[live], symbols[live], ranks[live], joins[live], best[live]
            if not len(rows):
                return
            each = np.arange(len(rows))
            symbols[each, best] = joins[each, best]
            place = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, place + (place > best[:, None]), axis=1)
            place = place[:-1]
            keep = place + (place >= best[:, None])
            ranks, joins = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(joins, keep, axis=1)
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 2)
                r, s = each[ok], side[ok]
                ranks[r, s], joins[r, s] = self._look_up(symbols[r, s], symbols[r, s + 1])

    def _by_merging(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _bytes_of(parts)
        sizes = np.diff(offsets)
        counts, begins, ids, held = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64), [np.zeros(0, dtype="<u4")], 0
        for size in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == size)
            for rows, symbols in self._merged(data[offsets[places][:, None] + np.arange(size)]):
                counts[places[rows]] = symbols.shape[1]
                begins[places[rows]] = held + symbols.shape[1] * np.arange(len(rows))
                ids.append(symbols.astype("<u4").ravel())
                held += symbols.size
        return gathered(np.concatenate(ids), begins, counts), counts

    def _by_library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = list(self.whole(words.to_pylist()))
        return np.frombuffer(b"".join(coded), dtype="<u4"), np.array([len(x) // 4 for x in coded], dtype=np.int64)

    def _taken_apart(self, plain: pa.Array, marked: list[list[str]]) -> Coded:
        """Of words in one case without apostrophes, then of those that are given by their parts."""
        data, offsets = _bytes_of(plain)
        kind = _KIND[data]
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[offsets[:-1]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        parts = pa.concat_arrays([parts, pa.array([x for word in marked for x in word], pa.string())])
        until = np.concatenate([np.searchsorted(begins, offsets), len(begins) + np.cumsum([len(word) for word in marked], dtype=np.int64)])
        told = parts.dictionary_encode()
        at = told.indices.to_numpy()
        ids, first, counts = self.parts.look_up(told.dictionary)
        ids = gathered(ids, first[at], counts[at])
        before = np.concatenate([[0], np.cumsum(counts[at])])[until]
        return ids, before[:-1], np.diff(before)

    def encoded(self, words: pa.Array) -> Coded:
        """The ids of distinct words; an empty one has none."""
        begins, counts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        plain = np.zeros(len(words), dtype=bool)
        if self.known:
            plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, SPECIAL)).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain & (pc.binary_length(words).to_numpy() > 0))
        texts = words.take(pa.array(rest)).to_pylist()
        marked = np.array([self.known and len(w) <= LONGEST and _SIMPLE(w) is not None and SPECIAL not in w for w in texts], dtype=bool)
        others, all_ids, held = rest[~marked], [np.zeros(0, dtype="<u4")], 0
        groups = [(others, self.words.look_up(words.take(pa.array(others))))] if len(others) else []
        if plain.any() or marked.any():
            apart = [_PARTS(w.lower()) for w, ours in zip(texts, marked.tolist(), strict=True) if ours]
            groups.append((np.concatenate([np.flatnonzero(plain), rest[marked]]), self._taken_apart(pc.utf8_lower(words.filter(pa.array(plain))), apart)))
        for places, (ids, first, many) in groups:
            begins[places], counts[places] = held + first, many
            all_ids.append(ids)
            held += len(ids)
        return np.concatenate(all_ids), begins, counts

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        for start in range(0, len(words), WORDS_AT_ONCE):
            told = pa.array(words[start : start + WORDS_AT_ONCE], pa.string()).dictionary_encode()
            ids, begins, counts = self.encoded(told.dictionary)
            at = told.indices.to_numpy()
            yield from (ids[a : a + n].tobytes() for a, n in zip(begins[at].tolist(), counts[at].tolist(), strict=True))
