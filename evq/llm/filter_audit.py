"""How five document filters interact: what each removes in every order, alone, and on average.

A document is the set of filters it fails (a 5-bit mask), so per part of the table 32 counts say everything. The game
of removals gives a coalition S of filters the number of documents that fail one of S. Its Hart-Mas-Colell potential
is found by recursion over the 32 coalitions, P(S) = (v(S) + sum over i in S of P(S without i)) / |S|; a filter's
Shapley value is P(all) - P(all without it). What a filter removes at a step of an order is the difference of two
coalitions' values. All numbers are integers: 60 P is whole, as the divisors are 1 to 5.

Plan: one scan makes masks with Spark's own functions; exact copies are counted by the text's SHA-256 and doc_id, so a
text that a third of all rows share is a sum, never a group of rows; what is left is one row per part.

Defined results. A null text is empty, a null source the part ``""``. Words, code points and the first copy are those
of the whole text. A document with a null doc_id has no smaller id and is no one's first copy; rows that repeat a
doc_id are documents of their own, equal ids being no copies of each other. A doc_id with several labels is good
(toxic) if one of them says so. An empty table gives no rows. Columns with other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import written

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
ORDERS = list(permutations(range(len(FILTERS))))
#: The least common multiple of coalition sizes: potentials times this are whole.
SCALE = 60
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """The bits of A to D for a text that is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    # One struct, so that the words are split once.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0]
    short = counted["n"] < 50
    repetitive = 100 * counted["different"].cast("long") < 65 * counted["n"].cast("long")
    loud = 100 * capitals > 5 * F.length(text).cast("long")
    symbols = text.rlike("[#$%&*|]")
    return sum(F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate((short, repetitive, loud, symbols)))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part: arrays of 32 counts by failure mask, of all, good and toxic documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    seen = rows.select("doc_id", "part", text_failures(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    counted = seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    marked = written(counted.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}), "filter-audit")
    first = marked.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Joined by text and id, so a text with many copies meets one partner in one task.
    passing = marked.join(first, ["digest", "doc_id"], "left_semi").unionByName(marked.where("doc_id IS NULL"))
    copy_bit, key = COALITIONS >> 1, ["part", "good", "toxic"]
    parts = [
        marked.select(*key, (F.col("mask") + copy_bit).alias("mask"), "n"),
        passing.select(*key, (F.col("mask") + copy_bit).alias("mask"), (-F.col("n")).alias("n")),
        passing.select(*key, "mask", "n"),
    ]
    signed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*key, "mask").agg(F.sum("n").alias("n"))

    def counts(of: Column, name: str) -> Column:
        return F.array(*[F.sum(F.when(of & (F.col("mask") == m), F.col("n")).otherwise(0)) for m in range(COALITIONS)]).alias(name)

    return signed.groupBy("part").agg(counts(F.lit(True), "documents"), counts(F.col("good"), "good"), counts(F.col("toxic"), "toxic"))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """Values of all coalitions, one row per part: the documents that fail one of its filters."""
    coalition, mask = np.meshgrid(np.arange(COALITIONS), np.arange(COALITIONS))
    return counts @ ((coalition & mask) != 0).astype(np.int64)


def potentials(values: np.ndarray) -> np.ndarray:
    """``SCALE`` times the Hart-Mas-Colell potential of every coalition."""
    found = np.zeros_like(values)
    for coalition in range(1, COALITIONS):  # a coalition comes after its parts
        members = [i for i in range(len(FILTERS)) if coalition >> i & 1]
        rest = sum(found[:, coalition ^ (1 << i)] for i in members)
        found[:, coalition] = (SCALE * values[:, coalition] + rest) // len(members)
    return found


def audit_counts(documents: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of all orders and steps, per part an array of orders by steps."""
    values, good, toxic = removal_game(documents), removal_game(good), removal_game(toxic)
    potential, whole = potentials(values), COALITIONS - 1
    order = np.array(ORDERS)
    after = np.cumsum(1 << order, axis=1)  # the filters so far, as a coalition
    before, one = after - (1 << order), 1 << order
    removed = values[:, after] - values[:, before]
    shapley = (potential[:, whole, None, None] - potential[:, whole ^ one]) * len(ORDERS) // SCALE
    return {
        "kept": documents.sum(axis=1)[:, None, None] - values[:, after],
        "removed": removed,
        "redundant": values[:, one] - removed,
        "unique_fails": values[:, whole, None, None] - values[:, whole ^ one],
        "good_lost": good[:, after] - good[:, before],
        "toxic_lost": toxic[:, after] - toxic[:, before],
        "shapley": shapley,
    }


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array(["".join(FILTERS[i] for i in order) for order in ORDERS])
    per_part = len(ORDERS) * len(FILTERS)
    orders, steps = np.repeat(names, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            tables = [np.array(batch.column(name).to_pylist(), np.int64).reshape(-1, COALITIONS) for name in ("documents", "good", "toxic")]
            found = audit_counts(*tables)
            n = batch.num_rows
            part = batch.column(0).take(pa.array(np.repeat(np.arange(n), per_part)))
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(np.tile(orders, n)), pa.array(np.tile(steps, n)), *[pa.array(v.reshape(-1)) for v in found.values()]],
                ["part", "filter_order", "step", *found],
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    return failure_counts(docs, labels).mapInArrow(_audited, RESULT)
