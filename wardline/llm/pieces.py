"""Cut texts where the pre-tokeniser always cuts, and encode each distinct part once per worker.

The pattern of the byte-level vocabularies starts a new piece at every blank that is followed by a character
other than white space, whatever stands to the left. Parts between such blanks can be encoded on their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np

_UNSAFE = re.compile(r" (?=\s|\Z)")
_SAFE_CUT = re.compile(r" (?=\S)")
#: A worker keeps this many parts, none longer than LONGEST_KEPT; more are encoded again, which changes no result.
MOST_KEPT, LONGEST_KEPT = 500_000, 64


def cut(text: str) -> list[str]:
    """Parts of ``text``; all but the first lack the blank they start with."""
    return _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


class PartEncoder:
    """Encodes whole texts into packed little-endian unsigned 32-bit ids.

    ``encode_many`` takes strings and returns their packed ids in the same order. Texts for which ``whole`` holds are
    not cut: white space before an added token ends a text of its own there, and is no longer cut at every blank.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], whole: Callable[[str], bool] = lambda text: False):
        self.encode_many, self.whole = encode_many, whole
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """One text after the other, in groups of about three million characters."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append([text] if self.whole(text) else cut(text))
            size += len(text)
            if size > 3_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        known = self.kept
        fresh: set[str] = set()
        for parts in group:
            fresh.update(parts[1:])
        new = [part for part in fresh if part not in known]
        heads = [parts[0] for parts in group]
        packed = self.encode_many([" " + part for part in new] + heads)
        extra = {part: ids for part, ids in zip(new, packed) if len(part) > LONGEST_KEPT}
        known.update((part, ids) for part, ids in zip(new, packed) if len(part) <= LONGEST_KEPT)
        for parts, head in zip(group, packed[len(new):]):
            tail = parts[1:]
            if extra:
                yield head + b"".join([known[p] if p in known else extra[p] for p in tail])
            else:
                yield head + b"".join(map(known.__getitem__, tail))


class _Numbers(dict):
    """Number of each part, given when it is first met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number


class NumberedParts:
    """Encodes whole texts into arrays of ids: each part has a number, and the ids of all numbers lie in one array.

    ``encode_parts`` takes parts without the blank that each starts with and returns their ids in one array, and where
    each part's begin and how many they are; ``encode_whole`` returns an array of ids a string. Texts for which ``whole`` holds are not cut. A table of more than MOST_KEPT parts or
    MOST_LETTERS letters is begun anew, which changes no result.
    """

    MOST_KEPT, MOST_LETTERS = 800_000, 32_000_000

    def __init__(
        self, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], encode_whole: Callable[[list[str]], list[np.ndarray]],
        whole: Callable[[str], bool],
    ):
        self.encode_parts, self.encode_whole, self.whole = encode_parts, encode_whole, whole
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.letters = _Numbers(), 0
        self.ids, self.begins, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """One text after the other, in groups of about three million characters."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append([text] if self.whole(text) else cut(text))
            size += len(text)
            if size > 3_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.numbers) > self.MOST_KEPT or self.letters > self.MOST_LETTERS:
            self._begin()
        parts = chain.from_iterable(islice(of_text, 1, None) for of_text in group)
        many = np.asarray([len(of_text) - 1 for of_text in group], np.int64)
        number = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, int(many.sum()))
        if self.numbers.new:
            ids, begins, sizes = self.encode_parts(self.numbers.new)
            self.letters += sum(map(len, self.numbers.new))
            self.numbers.new = []
            self.begins = np.concatenate([self.begins, begins + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        sizes = self.sizes[number]
        after = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begins[number] - after[:-1], sizes) + np.arange(after[-1])]
        of_text = after[np.concatenate([[0], np.cumsum(many)])]
        for head, begin, end in zip(self.encode_whole([parts[0] for parts in group]), of_text[:-1].tolist(), of_text[1:].tolist()):
            yield np.concatenate([head, ids[begin:end]])
