"""Numbering words and looking up n-grams of integer tokens, for the n-gram models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_values

PIECE = 4 << 20


def pieces_of(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at ASCII white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


class Numbers(dict):
    """word -> number by ``make``, kept for the words met lately: two generations of about ``keep``."""

    def __init__(self, make: Callable[[bytes], int], keep: int = 150_000, kind: type = np.int64):
        self.make, self.keep, self.kind, self.before = make, keep, kind, {}

    def __missing__(self, word: bytes) -> int:
        out = self.before.get(word)
        self[word] = out = self.make(word) if out is None else out
        return out

    def of(self, text: bytes, table: bytes | None = None) -> np.ndarray:
        """The numbers of the words between ASCII white space, in order; ``table`` maps the bytes first."""
        return self.of_all([text], table)[0]

    def of_all(self, texts: list[bytes], table: bytes | None = None) -> list[np.ndarray]:
        """of() for each text; each distinct word of the texts is looked up once."""
        if any(len(x) > PIECE for x in texts):
            none = np.zeros(0, dtype=self.kind)
            return [np.concatenate([none, *(self._of_all([p], table)[0] for p in pieces_of(x))]) for x in texts]
        return self._of_all(texts, table)

    def _of_all(self, texts: list[bytes], table: bytes | None) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self) > self.keep:
            self.before = dict(self)
            self.clear()
        column = pa.array([x.translate(table) for x in texts] if table else texts, type=pa.binary()).view(pa.string())
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten().view(pa.binary()).dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, known), dtype=self.kind, count=len(known))
        which, ends = words.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        if b"" in known:  # white space at an end of a text leaves an empty word
            full = which != known.index(b"")
            ends, which = np.concatenate([[0], np.cumsum(full)])[ends], which[full]
        return np.split(numbers[which], ends[:-1])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small parts of the batches, each with the bytes of its texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, byte_values(batch.column("text"))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The values of ``wanted``, best in ascending order, in the table with sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)
