"""Words of many texts at once: byte buffers, byte classes and spans, for tasks that work in numpy.

All separators of the contracts are ASCII, so bytes of longer characters always
belong to words and a text may be read as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEPARATOR, WORD, BREAK = 0, 1, 2
#: Bytes of text that are read at once.
SLICE = 4 << 20
#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """WORD for each byte but separators, and breaks, which also end a piece."""
    out = np.full(256, WORD, dtype=np.uint8)
    out[list(separators)] = SEPARATOR
    out[list(breaks)] = BREAK
    return out


class Words(NamedTuple):
    """Spans of words in a buffer, the text that each is in, and whether a break or another text lies before it."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of a string column, null as empty, and where each text begins, with the end of the last."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return LOWER[whole[at[0] : at[-1]]], at - at[0]


def words_of(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> Words:
    """The words of all texts in a buffer."""
    kind = classes[data]
    word = kind == WORD
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(at, start, side="right") - 1
    past = np.searchsorted(np.flatnonzero(kind == BREAK), start)
    first = np.ones(len(start), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (past[1:] != past[:-1])
    return Words(data, start, end, row, first)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string()).fill_null("")
        past = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(text):
            upto = max(at + 1, int(np.searchsorted(past, past[at] + size, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def segments(data: np.ndarray, at: np.ndarray, classes: np.ndarray, cut: int, overlap: int = 0, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The buffer in parts where a single long text is cut, each with its text offsets and the number of leading words that the part before had too.

    cut: the class of the bytes at which a text may be cut. A text without such
    a byte stays whole. overlap: words that a part repeats from the one before.
    """
    if len(at) != 2 or len(data) <= 2 * size:
        yield data, at, 0
        return
    begin, repeated = 0, 0
    while begin < len(data):
        end = begin + size
        while end < len(data):
            found = np.flatnonzero(classes[data[end : end + size]] == cut)
            if len(found):
                end += int(found[0])
                break
            end += size
        end = min(end, len(data))
        part = data[begin:end]
        yield part, np.array([0, len(part)]), repeated
        if end == len(data):
            return
        back = words_of(part, np.array([0, len(part)]), classes).start[-overlap:] if overlap else np.zeros(0, dtype=np.int64)
        begin, repeated = (begin + int(back[0]), len(back)) if len(back) else (end, 0)


def spans_as_array(words: Words, chosen: slice = slice(None)) -> pa.Array:
    """The words as a binary Arrow array."""
    start, end = words.start[chosen], words.end[chosen]
    size = end - start
    past = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - past[:-1], size) + np.arange(past[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(past.astype(np.int64)), pa.py_buffer(words.data[take])])
