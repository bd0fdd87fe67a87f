"""Texts as dictionary-encoded words: each distinct word of an Arrow batch is handled once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """values: distinct words; codes: the words of all texts in order; offsets: where each text's words begin."""

    values: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def encode(lists: pa.Array) -> Words:
    """Lists of strings with their strings dictionary-encoded; empty strings go."""
    ends = np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        held = codes != blank
        ends = np.concatenate([[0], np.cumsum(held)])[ends]
        codes = codes[held]
    return Words(coded.dictionary, codes, ends)


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; lower: A-Z become a-z first."""
    text = whole(column)
    return encode(pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every (start, length) range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


#: Bytes of text that are taken together.
SLICE = 8 << 20


def slices(batch: pa.RecordBatch, text: pa.Array, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``size`` bytes of ``text``; one row at least, so memory follows bytes and not rows."""
    held = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(held[start - 1]) if start else 0
        stop = max(int(np.searchsorted(held, before + size, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop
