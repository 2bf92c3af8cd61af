"""Runs of bytes of a class in whole texts, found by numpy, and their numbers among the distinct ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is cut between words.
SIZE = 1 << 22


def classes(*sets: bytes) -> np.ndarray:
    """The class of each byte: 0, or the number of the set that holds it."""
    out = np.zeros(256, np.uint8)
    for number, some in enumerate(sets, 1):
        out[list(some)] = number
    return out


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(kind)]])


def numbered(data: np.ndarray, kept: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each run among the distinct ones, and these in the order of their numbers: the runs are the bytes that the
    mask keeps, one after another, of the sizes given."""
    if not len(sizes):
        return np.zeros(0, np.int64), []
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], text: int, keep: int) -> Iterator[tuple[list, list[bytes]]]:
    """Values of a column and texts (null: empty) of successive rows, about SIZE bytes of text at a time; a longer text alone."""
    values: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for value, t in zip(batch.column(keep).to_pylist(), batch.column(text).cast(pa.large_binary())):
            t = t.as_py() or b""
            if texts and held + len(t) > SIZE:
                yield values, texts
                values, texts, held = [], [], 0
            values.append(value)
            texts.append(t)
            held += len(t)
    if texts:
        yield values, texts


def parts(text: bytes, separator: re.Pattern, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """(begin, end) of the parts of a text of about so many bytes, cut where a separator stands (which the next part begins with)."""
    begin = 0
    while True:
        end = min(begin + size, len(text))
        if end < len(text):
            found = separator.search(text, end)
            end = found.start() if found else len(text)
        yield begin, end
        if end == len(text):
            return
        begin = end
