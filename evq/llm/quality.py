"""Quality filter: fixed rules, then a log-likelihood ratio of hashed word n-grams.

Words and word pairs are hashed to buckets, whose number grows with the corpus as its
distinct words do. Two multinomials over the buckets, one of all trusted documents and
one of the whole raw corpus, score a document by the mean log ratio of its n-grams. A
document is kept if no rule rejects it and its score is not below the threshold; the
same document always gets the same verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import map_text, small_batches, written
from evq.llm.words import SPACE_WORDS, Words, count_by_document, covered, inside_document, mix, release_memory, span_hashes, split_words, text_blocks, text_buffer, window_hashes
from evq.plans.positions import with_range

#: Buckets of the hashed n-grams: so many at least, and per square root of the corpus's bytes (distinct words grow
#: about with the square root of all words), as the next power of two.
LEAST_BUCKETS = 1 << 16
BUCKETS_PER_ROOT = 4
#: Added to every bucket's count, as a share of a uniform corpus of that many n-grams.
SMOOTHING = 1.0
#: One in so many good documents is kept from the trusted multinomial, for the threshold.
PROBE_SHARE = 5
#: Threshold where no labelled document says otherwise.
DEFAULT_THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


class Model(NamedTuple):
    weights: np.ndarray
    threshold: float


def number_of_buckets(corpus_bytes: int) -> int:
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1.0, BUCKETS_PER_ROOT * math.sqrt(corpus_bytes)))))


def buckets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the document of each."""
    document = np.repeat(np.arange(len(words.first) - 1), words.counts)
    pairs = inside_document(words.first, 2)
    two = window_hashes(words.hashes, 2)[pairs]
    return (np.concatenate([words.hashes, two]) & np.uint64(size - 1)).astype(np.int64), np.concatenate([document, document[pairs]])


def rule_counts(column: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The counts that the fixed rules look at, per document."""
    data, offsets = text_buffer(column)
    inside = SPACE_WORDS[data]
    lead = (data & 0xC0) != 0x80
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    feeds = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets, feeds, feeds + 1]))
    starts, ends = bounds[:-1], bounds[1:]
    total = np.concatenate([[0], np.cumsum(inside)])
    full = total[ends] > total[starts]
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    line_key = np.unique(np.stack([line_doc.astype(np.uint64), span_hashes(data, starts, ends)]), axis=1)
    docs = len(offsets) - 1
    duplicate = np.bincount(line_doc, minlength=docs) - np.bincount(line_key[0].astype(np.int64), minlength=docs)
    at = inside_document(words.first, 3)
    doc = np.repeat(np.arange(docs), np.maximum(words.counts - 2, 0))
    key = window_hashes(words.hashes, 3)[at] ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = covered(len(words.hashes), at[times[inverse] > 1] if len(at) else at, 3)
    return {
        "n_words": words.counts,
        "word_chars": count_by_document(inside & lead, offsets),
        "n_symbols": count_by_document(symbol, offsets),
        "n_dup_lines": duplicate,
        "n_repeat_words": count_by_document(repeated, words.first),
    }


def scores(words: Words, weights: np.ndarray) -> np.ndarray:
    """Mean log ratio of each document's n-grams; 0 without any."""
    bucket, doc = buckets(words, len(weights))
    docs = len(words.first) - 1
    sums = np.bincount(doc, weights=weights[bucket], minlength=docs)
    return sums / np.maximum(np.bincount(doc, minlength=docs), 1)


def _verdicts(labels: DataFrame) -> DataFrame:
    """``doc_id, quality, probe`` of the labelled ids; an id labelled both good and bad is bad."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.withColumn("probe", _is_probe())


def _is_probe() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(PROBE_SHARE)) == 0


def _ngram_counts(texts: DataFrame, size: int, name: str) -> DataFrame:
    """``bucket`` and the number of n-grams in it; one row per bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                found += np.bincount(buckets(split_words(block.column(0)), size)[0], minlength=size)
            release_memory()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bucket", name])

    return small_batches(texts.select("text")).mapInArrow(count, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts of all documents and of all trusted ones, and the threshold from all other labelled ones.

    Trusted are the labelled good documents but every fifth. What reaches the driver is one row per bucket, and one per
    range of scores. A last pass scores the labelled documents that the trusted counts do not know, the good ones left
    out and all bad ones: the threshold lies midway between the scores that best separate the two classes, and is a
    constant if one is missing.
    """
    verdicts = _verdicts(labels)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = number_of_buckets(chosen.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    # Labels grow with the corpus, so texts and ids are shuffled at every size; null ids and probes are left out before.
    trusted = verdicts.where("quality = 1 AND NOT probe").hint("merge")
    trusted_docs = chosen.where(F.col("doc_id").isNotNull() & ~_is_probe()).join(trusted, "doc_id", "left_semi")
    counted = _ngram_counts(chosen, size, "raw").join(_ngram_counts(trusted_docs, size, "trusted"), "bucket", "left").toArrow()
    raw, trusted = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    at = counted.column("bucket").to_numpy()
    raw[at] += counted.column("raw").to_numpy()
    known = counted.column("trusted").fill_null(0).to_numpy()
    trusted[at] += known
    if not known.any():
        return Model(np.zeros(size, np.float32), DEFAULT_THRESHOLD)
    weights = (np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())).astype(np.float32)
    # Every text is scored where it lies, so that ids and scores are shuffled and no text is.
    held = verdicts.where("quality = 0 OR probe").select("doc_id", (F.col("quality") == 1).alias("good")).hint("merge")
    scored = _scored(chosen.where("doc_id IS NOT NULL"), weights).join(held, "doc_id")
    # Rows of one id and score count once, however often they are repeated.
    scored = scored.groupBy("doc_id").agg(F.min("score").alias("score"), F.first("good").alias("good"))
    return Model(weights, threshold_of(written(scored.select("score", "good"), "scores")))


def _scored(chosen: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of the rows that no rule rejects."""
    sent = chosen.sparkSession.sparkContext.broadcast(weights)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(block.column(1))
        passed = pa.array(~_failed(rule_counts(block.column(1), words)))
        return pa.RecordBatch.from_arrays([block.column(0).filter(passed), pa.array(scores(words, sent.value)).filter(passed)], ["doc_id", "score"])

    return map_text(chosen, run, "doc_id long, score double")


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors, each class weighed by its size; midway between the scores beside it."""
    if not len(good) or good.all() or not good.any():
        return DEFAULT_THRESHOLD
    values, of = np.unique(score, return_inverse=True)
    found = _best_cut(values, np.bincount(of[good], minlength=len(values)), np.bincount(of[~good], minlength=len(values)), (good.sum(), (~good).sum()))
    return _limit([found], values[0])


def threshold_of(scored: DataFrame) -> float:
    """:func:`threshold` of a table ``score, good`` of any size.

    Distinct scores are dealt to ranges between their quantiles. With the sizes of the ranges before it, each range
    finds its own best cut; the driver takes the best of these.
    """
    each = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    placed = written(with_range(each, F.col("score")), "score-ranges")
    ranges = sorted(placed.groupBy("_range").agg(F.sum("good"), F.sum("bad"), F.min("score")).collect())
    total = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    if not all(total):
        return DEFAULT_THRESHOLD
    begins = {}
    before = (0, 0)
    for r, after in zip(ranges, [*ranges[1:], None]):
        begins[r[0]] = before, after and after[3]
        before = before[0] + r[1], before[1] + r[2]

    def cut(table: pa.Table) -> pa.Table:
        score, good, bad = (table.column(c).to_numpy() for c in ("score", "good", "bad"))
        order = np.argsort(score)
        error, last, limit = _best_cut(score[order], good[order], bad[order], total, *begins[table.column("_range")[0].as_py()])
        return pa.table({"error": [error], "score": [last], "limit": [limit]})

    found = placed.groupBy("_range").applyInArrow(cut, "error double, score double, limit double")
    return _limit([tuple(r) for r in found.collect()], ranges[0][3])


def _best_cut(score: np.ndarray, good: np.ndarray, bad: np.ndarray, total: tuple[int, int], before: tuple[int, int] = (0, 0), after: float | None = None) -> tuple[float, float, float]:
    """Error, score and threshold of the best cut above one of the sorted distinct scores, the first of equal ones.

    ``good`` and ``bad`` are the documents of each score, ``before`` those of smaller scores; ``after`` is the next larger score.
    A cut above a score lets the bad ones out; the best one is always above a bad one, and below the good ones of that score.
    """
    lost = (before[0] + np.cumsum(good) - good) / total[0]
    errors = np.where(bad > 0, lost + (1 - (before[1] + np.cumsum(bad)) / total[1]), np.inf)
    cut = int(np.argmin(errors))
    above = score[cut + 1] if cut + 1 < len(score) else score[cut] if after is None else after
    return float(errors[cut]), float(score[cut]), float(score[cut] if good[cut] else (score[cut] + above) / 2)


def _limit(found: list[tuple[float, float, float]], least: float) -> float:
    """The threshold of the best cut; below the least score if none is better than no cut."""
    error, _, limit = min(found)
    return limit if error < 1 else float(least) - 1e-9


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with the rules' counts, ``base_failed``, ``score`` and ``kept``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        get = {name: block.column(i) for i, name in enumerate(block.schema.names)}
        words = split_words(get["text"])
        counts = rule_counts(get["text"], words)
        failed, score = _failed(counts), scores(words, sent.value.weights)
        values = [*(get[k] for k in keep), *(pa.array(counts[c], pa.int64()) for c in _COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= sent.value.threshold))]
        return pa.RecordBatch.from_arrays(values, schema.fieldNames())

    return map_text(docs, run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with counts and verdict.

    A null text has no words and fails the rules; very long texts are read whole; a score equal to the threshold is
    kept; without trusted documents all scores are 0 and the constant threshold keeps what passes the rules; an id
    labelled both good and bad is bad; repeated rows count as often as they occur; columns other than ``doc_id`` and
    ``text`` are not read; an empty table gives no rows.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge(chosen, fit(docs, labels), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    judged = judge(row, fit(docs, labels), ["_row"]).where("kept")
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
