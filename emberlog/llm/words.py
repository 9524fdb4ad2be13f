"""Words of whole texts as arrays of hashes, for the operators that run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in slices of about so many characters (a longer text is a slice of its own).
SLICE_CHARS = 3_000_000
_CACHE_WORDS = 400_000


class WordHashes(dict):
    """XXH64 of words under a seed, remembered up to a bounded number of words."""

    def __init__(self, seed: int, limit: int = _CACHE_WORDS):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Maximal runs of characters that are not ASCII white space, in UTF-8 (which is just what bytes.split() gives)."""
    return text.encode().split() if text else []


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def word_slices(text: str | None, limit: int = SLICE_CHARS) -> Iterator[list[bytes]]:
    """The words of a text in turn, from about ``limit`` characters at a time, so that the words of a very long text are never all in memory."""
    start = 0
    while text and start < len(text):
        end = len(text)
        if end - start > limit:
            cut = _SPACE.search(text, start + limit)
            end = cut.start() if cut else end
        yield text[start:end].encode().split()
        start = end


def slices(batch: pa.RecordBatch, text: int, size: Callable[[memoryview], int] = len, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold ``limit`` characters or one row, whichever is more. ``size``: a text's length from its bytes."""
    column = batch.column(text)
    lengths = [size(memoryview(column[i].as_buffer())) if column[i].is_valid else 0 for i in range(len(column))]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def sequences(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in a row, and the n + 1 places where texts start and end."""
    words: list[bytes] = []
    ends = [0]
    for t in texts:
        words += split(t)
        ends.append(len(words))
    return words, np.array(ends, dtype=np.int64)
