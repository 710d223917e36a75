"""Packing of documents into fixed-length training sequences.

Documents are cut into full pieces and one remainder; the pieces of randomised
groups of documents are placed first-fit decreasing. A tournament tree over the
bins' free space finds the first bin that fits in logarithmic time. Groups are
independent, so the plan shuffles a few integers per piece and no token ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import small_batches
from evq.llm.tokens import BatchEncoder, tokenizer_path
from evq.llm.words import mix, release_memory, text_blocks

#: Tokens in a sequence.
SEQUENCE = 2048
#: Documents in a group, on average.
GROUP_DOCUMENTS = 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free space of bins; every inner node holds the largest below it."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; its number."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        bin_number = node - self.width
        node //= 2
        while node:
            largest = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == largest:
                break
            tree[node] = largest
            node //= 2
        return bin_number


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    offsets[order[:full]] = 0
    rest = order[full:]
    if len(rest):
        tree = Tournament(len(rest), capacity)
        used: dict[int, int] = {}
        for piece, length in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
            at = tree.first_fit(length)
            bins[piece] = full + at
            offsets[piece] = used.get(at, 0)
            used[at] = offsets[piece] + length
    return bins, offsets


def cut_documents(docs: DataFrame, groups: int, tokenizer: str | None = None, end_id: int = 1, sequence: int = SEQUENCE, seed: int = 7) -> DataFrame:
    """Pieces of every document, with the random group of its row.

    The group follows from the task's number and the row's place in it: equal rows spread over all
    groups, and a task that runs again deals the same groups.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder.get(path)
        base, rows = (TaskContext.get().partitionId() + 1) * (1 << 40) + (seed << 32), 0
        for batch in batches:
            for block in text_blocks(batch, "text"):
                found, offsets = encoder.encode(block.column(1))
                group = mix(np.arange(rows, rows + block.num_rows, dtype=np.uint64) + np.uint64(base)) % np.uint64(groups)
                rows += block.num_rows
                ids = np.insert(found, offsets[1:], end_id).astype("<u4")
                tokens = np.diff(offsets) + 1
                pieces = -(-tokens // sequence)
                row = np.repeat(np.arange(len(tokens)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * sequence
                length = np.minimum(tokens[row] - start, sequence)
                at = (offsets[:-1] + np.arange(len(tokens)))[row] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, sums, tokens[row], group[row].astype(np.int64)))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group"],
                )
            release_memory()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(chosen).mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, group_documents: int = GROUP_DOCUMENTS, sequence: int = SEQUENCE, **options) -> DataFrame:
    """Sequences of at most ``sequence`` tokens: one row per piece.

    A null text is empty and still has its end id, a null ``doc_id`` stays null, equal rows are packed
    one by one, a text of any length is cut into pieces, pieces of equal length are packed in the order met; other
    columns, whatever their names, are ignored; an empty table gives no rows. ``sequence_id`` is the group's
    number times 2^32 plus the number of the sequence in its group.
    """
    groups = max(1, -(-docs.count() // group_documents))

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), sequence)
        group = table.column("group").to_numpy()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return cut_documents(docs, groups, sequence=sequence, **options).groupBy("group").applyInArrow(pack, _PACKED)
