"""Repeated passages of at least 50 words, found by level-wise doubling.

Every window of 50 words is assigned to the least-hashed 13-word window inside
it. Equal 50-word windows share that anchor, and neighbouring windows mostly do,
so there is one row per anchor (about every twentieth word) and not one per word.

* Level 13: an anchor whose 13 words occur in one document alone is dropped.
* Level 26: an anchor stays if its 13 words and the 13 after, or before, occur in
  two documents. Every 50-word window holds one of the two around its anchor.
* Level 50: all windows of an anchor lie in its context, 50 to 87 words. Of equal
  contexts all but the one of the smallest document are covered whole. Only that
  one sends its 50-word windows, and only where its 26 words have been seen in
  other contexts too; the smallest document of each window settles the rest.

Shuffled rows are fixed-size hashes; aggregations combine before the shuffle, so
a passage in a third of all documents is no hot spot there. The verdicts of
frequent values, of which there are few by definition, go to every task; their
rows, and those without a value, are spread by a hash of their own position in
the join that brings the other verdicts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import map_text, written
from evq.llm.words import Words, covered, inside_document, join_hashes, replaced, span_hashes, split_words, text_blocks, text_buffer, window_hashes, without_words

#: Words of a window and of the levels below.
WINDOW = 50
LEVEL_1 = 13
LEVEL_2 = 2 * LEVEL_1
#: A value in more than one of so many rows is frequent, so there are fewer frequent values than this.
FREQUENT = 10_000
_ANCHORS = "place long, mark int, start int, windows int, level_1 long, right long, left long, context long, second long"
_SPANS = "place long, mark int, spans array<int>"


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of every anchor, and the anchor."""
    starts = inside_document(words.first, WINDOW)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    n = len(words.hashes)
    bits = np.uint64(n.bit_length())
    key = window_hashes(words.hashes, LEVEL_1)
    key = ((key >> bits) << bits) | np.arange(len(key), dtype=np.uint64)  # the leftmost of equal ones
    width, span = WINDOW - LEVEL_1 + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(anchor)) + 1
    return starts[np.concatenate([[0], edge])], starts[np.concatenate([edge - 1, [len(starts) - 1]])], anchor[np.concatenate([[0], edge])]


def _anchor_rows(block: pa.RecordBatch) -> pa.RecordBatch:
    words = split_words(block.column(2))
    low, high, anchor = _anchors(words)
    doc = np.searchsorted(words.first, low, side="right") - 1
    double = window_hashes(words.hashes, LEVEL_2)

    def extension(at: np.ndarray, side: int) -> pa.Array:
        there = (at >= words.first[doc]) & (at + LEVEL_2 <= words.first[doc + 1])
        safe = np.where(there, at, 0)
        values = join_hashes(double[safe], np.full(len(safe), side, np.uint64)) if len(double) else np.zeros(len(safe), np.uint64)
        return pa.array(values.view(np.int64), mask=~there)

    context = join_hashes(span_hashes(words.hashes, low, high + WINDOW), (anchor - low).astype(np.uint64))
    # a second hash of the context's own words: its first and last window cover it
    ends = window_hashes(words.hashes, WINDOW)
    second = join_hashes(join_hashes(ends[low], ends[high]), (high - low).astype(np.uint64)) if len(low) else np.zeros(0, np.uint64)
    level_1 = window_hashes(words.hashes, LEVEL_1)[anchor] if len(anchor) else np.zeros(0, np.uint64)
    rows = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [
            block.column(0).take(rows), block.column(1).take(rows),
            pa.array((low - words.first[doc]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32)),
            pa.array(level_1.view(np.int64)), extension(anchor, 1), extension(anchor - LEVEL_1, 2), pa.array(context.view(np.int64)), pa.array(second.view(np.int64)),
        ],
        ["place", "mark", "start", "windows", "level_1", "right", "left", "context", "second"],
    )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every 50-word window of the wanted stretches of each document."""
    for batch in batches:
        for block in text_blocks(batch, "text"):
            words = split_words(block.column(2))
            stretches = block.column(3)
            flat = np.asarray(stretches.flatten()).reshape(-1, 2).astype(np.int64)
            doc = np.repeat(np.arange(block.num_rows), np.diff(np.asarray(stretches.offsets)) // 2)
            count = flat[:, 1]
            start = np.repeat(flat[:, 0] + words.first[doc] - np.cumsum(count) + count, count) + np.arange(count.sum())
            row = np.repeat(doc, count)
            one = span_hashes(words.hashes, start, start + WINDOW)
            two = window_hashes(words.hashes, WINDOW)[start] if len(start) else one
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(rows), block.column(1).take(rows), pa.array((start - words.first[row]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["place", "mark", "start", "one", "two"],
            )


def _placed(docs: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """``place`` orders documents (null ids come last), ``mark`` tells apart rows of one id."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), F.hash(text).alias("mark"), text.alias("text"), *extra)


def _seen_twice(anchors: DataFrame, column: str) -> DataFrame:
    """Values of a level found in two documents: the verdict is whether their contexts differ."""
    return (
        anchors.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.min("place").alias("_first"), F.max("place").alias("_last"), F.min("context").alias("_low"), F.max("context").alias("_high"), F.count("*").alias("_rows"))
        .where("_first < _last").select(column, (F.col("_low") != F.col("_high")).alias("_verdict"), "_rows")
    )


def _smallest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values found in two documents: the verdict is the smaller one's place."""
    found = rows.groupBy(*columns).agg(F.min("place").alias("_verdict"), F.max("place").alias("_last"), F.count("*").alias("_rows"))
    return found.where("_verdict < _last").drop("_last")


def _with_verdict(rows: DataFrame, verdicts: DataFrame, columns: Sequence[str], size: int, name: str) -> DataFrame:
    """The rows, ``size`` in all, with the verdict of their values (null: none)."""
    spread, rest = columns[0], columns[1:]
    limit = size // FREQUENT
    frequent = verdicts.where(F.col("_rows") > limit).select(*columns, F.col("_verdict").alias("_frequent"))  # fewer than FREQUENT rows
    others = verdicts.where(F.col("_rows") <= limit).select(F.col(spread).alias("_key"), *rest, F.col("_verdict").alias("_other"))
    alone = F.col("_frequent").isNotNull() | F.col(spread).isNull()
    key = F.when(alone, F.xxhash64("place", "mark", "start")).otherwise(F.col(spread))
    verdict = F.when(F.col(spread).isNotNull(), F.coalesce("_frequent", "_other"))
    joined = rows.join(F.broadcast(frequent), list(columns), "left").withColumn("_key", key).join(others, ["_key", *rest], "left")
    return joined.withColumn(name, verdict).drop("_key", "_frequent", "_other")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per row with something to remove: ``place, mark, spans`` (word ranges, ``[from, to, ...]``)."""
    placed = _placed(docs)
    anchors = written(map_text(placed, _anchor_rows, _ANCHORS), "anchors")
    twice = _seen_twice(anchors, "level_1").withColumn("_verdict", F.lit(True))
    survivors = _with_verdict(anchors, twice, ["level_1"], anchors.count(), "twice").where("twice")
    single = written(survivors.drop("level_1", "twice"), "level-1")
    size, survivors = single.count(), single
    for side in ("right", "left"):
        survivors = _with_verdict(survivors, _seen_twice(single, side), [side], size, f"{side}_mixed")
    survivors = written(survivors.where("right_mixed IS NOT NULL OR left_mixed IS NOT NULL").select(
        "place", "mark", "start", "windows", "context", "second",
        (F.coalesce("right_mixed", F.lit(False)) | F.coalesce("left_mixed", F.lit(False))).alias("mixed"),
    ), "survivors")
    contexts = _with_verdict(survivors, _smallest(survivors, ["context", "second"]), ["context", "second"], survivors.count(), "first")
    later = contexts.where("place > first").select("place", "mark", F.array("start", F.col("start") + F.col("windows") - 1 + WINDOW).alias("span"))
    leading = contexts.where("mixed AND (first IS NULL OR place = first)").groupBy("place", "mark").agg(F.flatten(F.collect_list(F.array("start", "windows"))).alias("stretches"))
    wanted = placed.join(leading, ["place", "mark"])
    windows = wanted.mapInArrow(_window_rows, "place long, mark int, start int, one long, two long")
    windows = written(windows, "windows")
    judged = _with_verdict(windows, _smallest(windows, ["one", "two"]), ["one", "two"], windows.count(), "first")
    judged = judged.where("place > first").select("place", "mark", F.array("start", F.col("start") + WINDOW).alias("span"))
    return later.unionByName(judged).groupBy("place", "mark").agg(F.flatten(F.collect_list("span")).alias("spans"))


def _with_spans(docs: DataFrame, extra: list[Column]) -> DataFrame:
    """Every row of the documents with its spans (null: none)."""
    spans = repeated_spans(docs.select("doc_id", "text"))
    return _placed(docs, extra).join(spans, ["place", "mark"], "left").drop("place", "mark")


def _removed(words: Words, spans: pa.ListArray) -> np.ndarray:
    flat = np.asarray(spans.flatten()).reshape(-1, 2).astype(np.int64)
    each = np.asarray(pc.fill_null(pc.list_value_length(spans), 0)) // 2
    base = np.repeat(words.first[:-1], each)
    return covered(len(words.starts), flat[:, 0] + base, flat[:, 1] - flat[:, 0])


def kept_words(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``.

    A null text has no words; a null ``doc_id`` is larger than any other, and documents of one id (or
    without one) do not count against each other; repeated rows get equal results; texts of any length are read
    whole; other columns, whatever their names, are not read; an empty table gives no rows.
    """

    def judge(block: pa.RecordBatch) -> pa.RecordBatch:
        column, spans = block.column(0), block.column(2)
        words = split_words(column, hashed=False)
        removed = _removed(words, spans)
        data, offsets = text_buffer(column)
        sums, lost = [], []
        total = np.concatenate([[0], np.cumsum(removed)])
        for doc in range(block.num_rows):
            each = data[offsets[doc] : offsets[doc + 1]].tobytes().split()
            a, b = words.first[doc], words.first[doc + 1]
            lost.append(int(total[b] - total[a]))
            if lost[-1]:
                each = [w for w, gone in zip(each, removed[a:b].tolist(), strict=True) if not gone]
            sums.append(hashlib.sha256(b" ".join(each)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [block.column(1), pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
        )

    rows = _with_spans(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return map_text(rows, judge, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of their texts; ``n_chars``, if there, counts what is left."""
    rows = _with_spans(docs, [F.struct(*docs.columns).alias("_row")])
    schema = rows.select("_row").schema.add("_new", "string")

    def cut(block: pa.RecordBatch) -> pa.RecordBatch:
        column = block.column(0)
        words = split_words(column, hashed=False)
        texts = without_words(words, text_buffer(column)[1], _removed(words, block.column(2)))
        return pa.RecordBatch.from_arrays([block.column(1), replaced(column, texts)], ["_row", "_new"])

    new = {"text": F.col("_new"), "n_chars": F.char_length("_new").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return map_text(rows, cut, schema).select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
