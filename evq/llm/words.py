"""Vectorised word splitting and hashing over Arrow text columns.

A text column is handled as one byte buffer with document offsets; words, their
64-bit hashes and the hashes of windows of words are numpy arrays over the whole
buffer, so no Python object is made per word. Buffers are cut between documents
(``text_blocks``), which bounds memory at any number of rows; a single text
longer than a block is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK_BYTES = 2 << 20
#: Separator of the ASCII white space words: everything but space and 0x09-0x0D.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and all non-ASCII bytes, after lower-casing.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of a block: byte ranges, hashes, and per document the index of its first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; at least one row each."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, batch.num_rows
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = table
    return table


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of an integer array."""
    n = len(values)
    if n == 0 or len(starts) == 0:
        return np.empty(len(starts), np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power_table(_INVERSE, n)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_words(column: pa.Array, table: np.ndarray = SPACE_WORDS, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = span_hashes(data, starts, ends) if hashed else np.empty(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (across documents too: mask with ``inside_document``)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, result = hashes, 1, 0, None
    rest = width
    while rest:
        if rest & 1:
            part = power[done : done + n]
            result = part if result is None else join_hashes(result, part)
            done += size
        rest >>= 1
        if rest:
            power = join_hashes(power[: len(power) - size], power[size:])
            size *= 2
    return result


def inside_document(first: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the words at which a window of ``width`` words of one document starts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` positions lie inside one of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def count_by_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def without_words(words: Words, offsets: np.ndarray, removed: np.ndarray) -> dict[int, bytes]:
    """New texts of the documents that lose words: each run of removed words goes with the separators after it."""
    lost = count_by_document(removed, words.first)
    texts = {}
    for doc in np.flatnonzero(lost).tolist():
        a, b = int(words.first[doc]), int(words.first[doc + 1])
        begin, end = int(offsets[doc]), int(offsets[doc + 1])
        gone = removed[a:b]
        first = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
        last = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]))
        starts = words.starts[a:b][first]
        after = np.append(words.starts[a:b], end)[last + 1]
        kept, at = [], begin
        for cut_from, cut_to in zip(starts.tolist(), after.tolist(), strict=True):
            kept.append(words.data[at:cut_from].tobytes())
            at = cut_to
        kept.append(words.data[at:end].tobytes())
        texts[doc] = b"".join(kept)
    return texts


def replaced(column: pa.Array, texts: dict[int, bytes]) -> pa.Array:
    """The column as strings with some rows replaced."""
    column = column.cast(pa.string())
    if not texts:
        return column
    mask = np.zeros(len(column), dtype=bool)
    rows = sorted(texts)
    mask[rows] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([texts[r].decode("utf-8") for r in rows], pa.string()))
