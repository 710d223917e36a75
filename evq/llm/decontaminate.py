"""Benchmark passages in training documents.

Each task turns its documents into shards of about half a million words, builds an
FM-index of every shard over the benchmark's vocabulary (all other words are
breaks), searches all benchmark windows backwards at once, locates their
occurrences and merges them into spans of words to remove. The only data sent to
tasks are the benchmark's windows, in blocks of bounded size: a benchmark of
more than one block takes one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from evq.llm.fm_index import LONGEST, FMIndex
from evq.llm.tasks import small_batches
from evq.llm.words import ALNUM_WORDS, Words, covered, inside_document, release_memory, replaced, split_words, text_blocks, text_buffer, window_hashes, without_words

#: Words in a window; an item of fewer is one window.
WINDOW = 10
#: Bytes of text in a shard, and of benchmark text in one pass.
SHARD_BYTES = 3 << 20
BENCHMARK_BYTES = 4 << 20
_PIECE = 1 << 19


class Phrases(NamedTuple):
    """Distinct windows of benchmark items over a vocabulary of word hashes; symbols count from 1."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray  # items of window i: item_of[item_start[i]:item_start[i + 1]]
    item_start: np.ndarray
    items: list[str | None]


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    words = split_words(pa.array([text for _, text in items], pa.string()), ALNUM_WORDS, lower=True)
    vocabulary, symbol = np.unique(words.hashes, return_inverse=True)
    symbol = symbol + 1
    names = sorted({None if key is None else str(key) for key, _ in items}, key=lambda name: (name is not None, name))
    number = {name: i for i, name in enumerate(names)}
    owner = np.array([number[None if key is None else str(key)] for key, _ in items], np.int64)
    of_word = np.repeat(owner, words.counts)
    found: dict[bytes, int] = {}
    rows, pairs = [], set()
    full = inside_document(words.first, window)
    short = [(int(a), int(n)) for a, n in zip(words.first[:-1], words.counts, strict=True) if 0 < n < window]
    key = window_hashes(words.hashes, window)
    for start, length in [(int(s), window) for s in full] + short:
        name = key[start].tobytes() if length == window else words.hashes[start : start + length].tobytes() + b"short"
        at = found.setdefault(name, len(rows))
        if at == len(rows):
            rows.append((start, length))
        pairs.add((at, int(of_word[start])))
    windows = np.zeros((len(rows), window), np.int32)
    for i, (start, length) in enumerate(rows):
        windows[i, :length] = symbol[start : start + length]
    ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return Phrases(vocabulary, windows, np.array([n for _, n in rows], np.int64), ordered[:, 1], np.searchsorted(ordered[:, 0], np.arange(len(rows) + 1)), names)


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> Iterator[Phrases]:
    """The benchmark's windows, in blocks of at most about ``limit`` bytes of text each; repeated items come once."""
    chosen = benchmark.select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    for block in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield phrases([tuple(row) for row in part.collect()], window)


def occurrences(symbols: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence in a sequence of symbols that ends with a break."""
    starts, which = [], []
    overlap = wanted.windows.shape[1] - 1
    piece = min(_PIECE, LONGEST - 1)
    at = 0
    while at < len(symbols):
        part = symbols[at : at + piece + overlap]
        index = FMIndex(np.append(part, 0), len(wanted.vocabulary) + 1)
        low, high = index.ranges(wanted.windows, wanted.lengths)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        place = index.locate(rows)
        first = place < piece  # later ones belong to the next piece
        starts.append(place[first] + at)
        which.append(window[first])
        at += piece
    return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(column: pa.Array, wanted: Phrases):
    """Words of a shard, which of them lie inside an occurrence, and per document the numbers of the items found."""
    words = split_words(column, ALNUM_WORDS, lower=True)
    docs, count = len(words.first) - 1, len(words.hashes)
    at = np.searchsorted(wanted.vocabulary, words.hashes)
    at[at == len(wanted.vocabulary)] = 0
    symbol = np.where(wanted.vocabulary[at] == words.hashes, at + 1, 0) if len(wanted.vocabulary) else np.zeros(count, np.int64)
    document = np.repeat(np.arange(docs), words.counts)
    text = np.zeros(count + docs, np.int64)  # a break after each document
    text[np.arange(count) + document] = symbol
    starts, which = occurrences(text, wanted) if len(wanted.windows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc = np.searchsorted(words.first[:-1] + np.arange(docs), starts, side="right") - 1
    hit = covered(count, starts - doc, wanted.lengths[which])
    seen = np.unique(doc * max(1, len(wanted.windows)) + which)
    doc, which = np.divmod(seen, max(1, len(wanted.windows)))
    each = wanted.item_start[which + 1] - wanted.item_start[which]
    item = wanted.item_of[np.repeat(wanted.item_start[which] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    pairs = np.unique(np.repeat(doc, each) * max(1, len(wanted.items)) + item)
    doc, item = np.divmod(pairs, max(1, len(wanted.items)))
    return words, hit, doc, item


Finish = Callable[[dict[str, pa.Array], Words, list[list[int]], list[list[str]]], list[pa.Array]]


def _pass(docs: DataFrame, wanted: Phrases, schema: StructType, finish: Finish) -> DataFrame:
    """Search one block of windows and make each shard's columns of what it and earlier passes (``_runs``, ``_items``) found."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sent.value.items + [""], dtype=object)
        for batch in batches:
            for block in text_blocks(batch, "text", SHARD_BYTES):
                get = {name: block.column(i) for i, name in enumerate(block.schema.names)}
                words, hit, doc, item = search(get["text"], sent.value)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                runs = _by_document(edges, words.first)
                items: list[list[str]] = [[] for _ in range(block.num_rows)]
                for d, name in zip(doc.tolist(), names[item].tolist(), strict=True):
                    items[d].append(name)
                if "_runs" in get:
                    runs = [a + b for a, b in zip(get["_runs"].to_pylist(), runs, strict=True)]
                    items = [a + b for a, b in zip(get["_items"].to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays(finish(get, words, runs, items), schema.fieldNames())
            release_memory()

    return small_batches(docs).mapInArrow(run, schema)


def _by_document(edges: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Runs of hit words, as [from, to, from, to, ...] inside each document."""
    runs: list[list[int]] = [[] for _ in range(len(first) - 1)]
    for begin, end in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(first, begin, side="right")) - 1
        while begin < end:  # a run may go on into the next document
            to = min(end, int(first[doc + 1]))
            if to > begin:
                runs[doc] += [begin - int(first[doc]), to - int(first[doc])]
            begin, doc = to, doc + 1
    return runs


def search_all(docs: DataFrame, benchmark: DataFrame, schema: StructType, finish: Finish, window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """One pass over the documents per block of the benchmark; the last one makes the result.

    A null text has no words; an item without words has no window; an item without id is named by the
    empty string (and told from an item of that name); rows of one item id are one item; equal documents are
    searched one by one; texts of any length are searched whole; other columns, whatever their names, are not
    read; empty tables give no rows or no findings.
    """
    blocks = benchmark_blocks(benchmark, window, limit)
    wanted = next(blocks)
    for following in blocks:
        columns = [c for c in docs.columns if c not in ("_runs", "_items")]
        between = docs.select(*columns).schema.add("_runs", ArrayType(IntegerType())).add("_items", ArrayType(StringType()))

        def pass_on(get, words, runs, items, columns=columns):
            return [*(get[c] for c in columns), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

        docs, wanted = _pass(docs, wanted, between, pass_on), following
    return _pass(docs, wanted, schema, finish)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = chosen.select("doc_id").schema.add("_words", "long").add("_runs", ArrayType(IntegerType())).add("_items", ArrayType(StringType()))

    def facts(get, words, runs, items):
        return [get["doc_id"], pa.array(words.counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    found = search_all(chosen, benchmark, schema, facts, **options)
    pairs = F.expr("transform(sequence(0, size(_runs) - 2, 2), i -> struct(_runs[i] AS a, _runs[i + 1] AS b))")
    # ranges of several blocks may overlap: count each word once
    merged = F.expr("aggregate(array_sort(_pairs), struct(0 AS n, 0 AS e), (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.e)) AS n, greatest(s.e, x.b) AS e)).n")
    found = found.withColumn("_pairs", F.when(F.size("_runs") > 0, pairs))
    items = F.array_sort(F.transform(F.array_distinct("_items"), lambda i: F.coalesce(i, F.lit(""))))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.coalesce(merged, F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with all found passages cut out of their texts; ``n_chars``, if there, counts what is left."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    schema = row.select("_row").schema.add("_new", "string")

    def cut(get, words, runs, items):
        data, offsets = text_buffer(get["text"])
        gone = np.zeros(len(words.starts), dtype=bool)
        for doc, found in enumerate(runs):
            for a, b in zip(found[0::2], found[1::2], strict=True):
                gone[words.first[doc] + a : words.first[doc] + b] = True
        texts = without_words(words._replace(data=data), offsets, gone)  # not the lower-cased bytes
        return [get["_row"], replaced(get["text"], texts)]

    cleaned = search_all(row, benchmark, schema, cut, **options)
    new = {"text": F.col("_new"), "n_chars": F.char_length("_new").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cleaned.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))

