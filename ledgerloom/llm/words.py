"""Words of Arrow text columns as integer codes, without a Python object per word.

A word is a run of characters other than space and U+0009 to U+000D.  Each
record batch (Spark bounds its rows and its bytes) is cut into slices of bounded
text bytes; Arrow splits a slice and dictionary-encodes its words, so Python
sees each distinct word once a slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.held import give_back

#: Text bytes of a slice; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class WordSlice:
    rows: pa.RecordBatch
    text: pa.Array  # nulls as empty texts
    offsets: np.ndarray  # document i has codes[offsets[i]:offsets[i + 1]]
    codes: np.ndarray
    words: pa.Array  # distinct words by code

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of about ``limit`` text bytes, or one longer row, with the text column (nulls as '')."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for rows in _cut(batch, column, limit):
            more = _text_bytes(rows, column)
            if held and size + more > limit:
                yield _joined(held, column)
                held, size = [], 0
            held.append(rows)
            size += more
    if held:
        yield _joined(held, column)
    held.clear()
    give_back()


def _text_bytes(rows: pa.RecordBatch, column: str) -> int:
    return pc.sum(pc.binary_length(rows.column(rows.schema.get_field_index(column)))).as_py() or 0


def _joined(held: list[pa.RecordBatch], column: str) -> tuple[pa.RecordBatch, pa.Array]:
    rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return rows, pc.fill_null(rows.column(rows.schema.get_field_index(column)), "")


def _cut(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document offsets and the flat words of ``text``."""
    lists = pc.ascii_split_whitespace(text)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        flat = flat.filter(pa.array(keep))
    return offsets, flat


def word_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[WordSlice]:
    for rows, text in slices(batches, column, limit):
        offsets, flat = split(text)
        coded = flat.dictionary_encode()
        yield WordSlice(rows, text, offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins (and the end)."""
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
