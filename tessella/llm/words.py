"""Runs of letters and their counts, by arrays over the bytes of whole batches instead of row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; what a task holds besides its batch is some 30 times that.
STEP = 4 << 20
#: Rows that a task adds up before it gives them out.
TALLY_ROWS = 400_000

_BYTES = np.arange(256)
_ASCII_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Letters of ASCII and every byte of other characters.
WIDE = _ASCII_LETTER | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: The first of the two bytes of U+00C0 to U+00FF.
_LATIN = 0xC3


def wide(data: np.ndarray) -> np.ndarray:
    """Which bytes are letters of ASCII or parts of any character beyond it."""
    return WIDE[data]


def latin(data: np.ndarray) -> np.ndarray:
    """Which bytes are letters of ASCII or parts of U+00C0 to U+00FF."""
    lead = data == _LATIN
    found = _ASCII_LETTER[data] | lead
    found[1:] |= lead[:-1]
    return found


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts end to end, and where each text begins and the last one ends; null is empty."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[begins[0] : begins[-1]], begins - begins[0]


def _cut(data: np.ndarray, at: int, end: int, step: int, opens: Callable[[np.ndarray], np.ndarray]) -> int:
    """The last place up to at + step, or else the first one after it, where a piece may begin; else the end."""
    if at + step >= end:
        return end
    low, high, last = at + 1, at + step, True
    while low < end:
        found = np.flatnonzero(opens(data[low : high + 1])[:-1])
        if len(found):
            return low + int(found[-1 if last else 0])
        low, high, last = high, min(high + step, end), False
    return end


def pieces(data: np.ndarray, begins: np.ndarray, opens: Callable[[np.ndarray], np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, rows): the texts by the step; a longer text comes alone, in pieces that begin where opens() allows.

    opens() gets bytes and says of each whether a piece may begin there.
    """
    row = 0
    while row < len(begins) - 1:
        end = max(row + 1, int(np.searchsorted(begins, begins[row] + step, "right")) - 1)
        at, stop = int(begins[row]), int(begins[end])
        if stop - at <= step:
            yield data[at:stop], begins[row : end + 1] - at, np.arange(row, end)
        else:
            while at < stop:
                to = _cut(data, at, stop, step, opens)
                yield data[at:to], np.array([0, to - at]), np.array([row])
                at = to
        row = end


def runs(data: np.ndarray, begins: np.ndarray, letters: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The maximal runs of letters, A to Z lower-cased, as dictionary of bytes; and the number of the text of each."""
    own = letters(data)
    first = own.copy()
    first[1:] &= ~own[:-1]
    starts = begins[:-1][begins[:-1] < len(data)]
    first[starts] = own[starts]
    places = np.flatnonzero(first)
    offsets = np.append(np.flatnonzero(first[own]), np.count_nonzero(own)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[own]])])
    return words.dictionary_encode(), np.searchsorted(begins, places, "right") - 1


def counted(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct tuples of the keys, which are whole numbers from 0, and how often each stands there, or its weight."""
    code = np.zeros(len(keys[0]), np.int64)
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    for key, size in zip(keys, sizes, strict=True):
        code = code * size + key
    if weights is None:
        found, n = np.unique(code, return_counts=True)
    else:
        found, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, weights, len(found)).astype(np.int64)
    parts = []
    for size in reversed(sizes):
        parts.append(found % size)
        found = found // size
    return parts[::-1], n


class Tally:
    """Adds up rows by key within a task, and gives them out whenever it holds more than a bound."""

    def __init__(self, keys: list[str], sums: list[str], most: int = TALLY_ROWS):
        self.keys, self.sums, self.most, self.held, self.rows = keys, sums, most, [], 0

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows > self.most:
            self._merge()
            if 2 * self.rows > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        whole = pa.concat_tables(self.held)
        summed = whole.group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        self.held = [summed.select(self.keys + [f"{s}_sum" for s in self.sums]).rename_columns(self.keys + self.sums)]
        self.rows = self.held[0].num_rows

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            yield from self.held[0].to_batches()
        self.held, self.rows = [], 0
