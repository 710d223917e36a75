"""Token-id files: one concatenated id array, document boundaries in Elias-Fano code.

Layout of a file: the magic ``EVQTOK1\\0``; four little-endian 64-bit integers
(documents, of them without id at the front, ids, bytes an id); the Elias-Fano
code of the documents' ends in the id array; that of the document ids; the ids,
16 bits each where the vocabulary allows it, else 32. Files are named in
ascending order of document id, so a reader walks them in name order.

Every file is made of the rows of one range partition and carries a name that
follows from the partition: a task that runs again writes the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evq.llm.elias_fano import EliasFano
from evq.llm.tasks import new_folder, small_batches
from evq.llm.tokens import BatchEncoder, tokenizer_path
from evq.llm.words import release_memory, text_blocks

MAGIC = b"EVQTOK1\0"
_HEAD = struct.Struct("<qqqq")
#: A file is closed once its ids take this many bytes.
FILE_BYTES = 32 << 20


class TokenFile(NamedTuple):
    """A file's contents: document i has ``ids[start(i):end(i)]``."""

    ends: EliasFano
    doc_ids: EliasFano
    nulls: int
    ids: np.ndarray

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends.select(i)]


def encode_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    coded = EliasFano.encode(np.array(doc_ids[nulls:], dtype=np.int64)).to_bytes()
    head = _HEAD.pack(len(doc_ids), nulls, len(ids), width)
    return MAGIC + head + EliasFano.encode(ends).to_bytes() + coded + ids.astype(f"<u{width}").tobytes()


def decode_file(data: bytes) -> TokenFile:
    view = memoryview(data)
    if bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token-id file")
    _, nulls, count, width = _HEAD.unpack_from(view, len(MAGIC))
    at = len(MAGIC) + _HEAD.size
    ends, size = EliasFano.from_bytes(view[at:])
    doc_ids, more = EliasFano.from_bytes(view[at + size :])
    return TokenFile(ends, doc_ids, nulls, np.frombuffer(view, f"<u{width}", count, at + size + more))


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a file whole or not at all, on any file system that Arrow knows."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(content)
    system.move(hidden, f"{root}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``(doc_id, text)`` and write token-id files below ``folder``; the manifest, one row per file.

    A null text is empty; every document ends with ``end_id``. Documents lie in
    ascending order of ``doc_id``, null ids first, rows of the same id in the order
    of a hash of their text. An empty table gives no file. Range partitions are
    cut by id and hash together, so one repeated id is no hot spot.
    """
    path = tokenizer or tokenizer_path()
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder.get(path)
        width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, names, stats = TaskContext.get().partitionId(), 0, []
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> None:
            nonlocal names, held
            name = f"ids-{part:08d}-{names:06d}.bin"
            ends = np.cumsum(np.concatenate(counts))
            _put(folder, name, encode_file(doc_ids, ends, np.concatenate(ids), width))
            stats.append((name, len(doc_ids), int(ends[-1])))
            names += 1
            held = 0
            for kept in (doc_ids, counts, ids):
                kept.clear()

        for batch in batches:
            for block in text_blocks(batch, "text"):
                found, offsets = encoder.encode(block.column(1))
                with_end = np.insert(found, offsets[1:], end_id)
                doc_ids.extend(block.column(0).to_pylist())
                counts.append(np.diff(offsets) + 1)
                ids.append(with_end.astype(f"<u{width}"))
                held += len(with_end) * width
                if held >= file_bytes:
                    close()
            release_memory()
        if doc_ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*stats, strict=True) if stats else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "documents", "ids"])

    spark = docs.sparkSession
    manifest = f"{folder}/_manifest"
    small_batches(placed).mapInArrow(write, "file string, documents long, ids long").write.mode("overwrite").parquet(manifest)
    return spark.read.schema("file string, documents long, ids long").parquet(manifest)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files, in their order: ``doc_id, start, n_tokens, ids_crc32`` and the file's name.

    ``start`` counts the ids of all documents before. The sum over files before runs over the manifest alone
    (one row per file of some 32 MB).
    """
    spark = manifest.sparkSession
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "ids-*.bin").load(folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file = decode_file(batch.column(1)[row].as_buffer())
                ends = file.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                raw = file.ids.astype("<u4")
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pa.concat_arrays([pa.nulls(file.nulls, pa.int64()), pa.array(file.doc_ids.values())])
                name = batch.column(0)[row].as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ends), pa.string()), ids, pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                    ["file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("path", "content").mapInArrow(documents, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(placed, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all documents to token-id files and read them back."""
    folder = folder or new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder), folder)
