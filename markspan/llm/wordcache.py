"""A bounded cache of encoded words for one Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

CHARS = 4 << 20  # of texts that are split and looked up together


class WordCache:
    """Texts as the encoded forms of their words, one after another. When `room` new words have come in, words not used since
    then are forgotten: at most 2 * room words (about 200 bytes each) are held, besides those of the texts at hand."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[bytes]], room: int = 400_000):
        self.split, self.encode, self.room = split, encode, room
        self.new: dict[str, bytes] = {"": b""}  # blanks next to each other leave empty words
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.new) > self.room:
            self.old, self.new = self.new, {"": b""}
        words.discard("")
        wanted = words.difference(self.new)
        self.new.update((w, self.old[w]) for w in wanted.intersection(self.old))
        missing = list(wanted.difference(self.old))
        self.new.update(zip(missing, self.encode(missing), strict=True))

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.split(t) for t in texts]
        self._learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.new.__getitem__, words))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The encoded form of each text; null reads as empty."""
        waiting, chars = [], 0
        for t in texts:
            waiting.append(t or "")
            chars += len(waiting[-1])
            if chars >= CHARS:
                yield from self._together(waiting)
                waiting, chars = [], 0
        yield from self._together(waiting)
