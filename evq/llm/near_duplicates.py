"""Near duplicates: an n-gram Jaccard self-join by chosen paths.

Documents with equal shingle sets are one *set*; sets are what is joined.

1. Every set has a sketch of 64 min-hashed shingles. In each of several runs a
   node of the recursion picks two of the 64 places by a hash of its path, and a
   set goes to the two children named by its shingles at those places. Buckets of
   up to ``BUCKET`` sets are compared by brute force on their sketches, larger ones
   recurse; what is still large at the last level (sets that hardly differ) is
   compared in chunks, every pair of chunks by a task. The number of runs follows
   from the target recall.
2. Sketches that may be similar are linked, as stars inside each bucket, and the
   links' components are the candidate groups.
3. Inside a group all sets are compared exactly on their shingles, again by pairs of
   bounded chunks. That gives every set its number of links and the final classes;
   no row per pair is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.components import components
from evq.llm.tasks import map_text, written
from evq.llm.words import Words, join_hashes, mix, split_words, text_blocks, window_hashes

#: Words in a shingle; least Jaccard similarity of a link; share of links to find.
WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Places of a sketch, children of a node, levels of the recursion.
PLACES = 64
CHILDREN = 2
LEVELS = 3
#: Sets compared with each other in one task.
BUCKET = 512
#: Bytes of text compared with each other in one task, about.
CHUNK_BYTES = 8 << 20
#: Sketches that agree this much less than the similarity are still candidates (five standard deviations).
MARGIN = 0.25


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY - 0.1) -> int:
    """Runs after which a pair has met with probability ``recall``: it must share a path to the deepest level in one."""
    meets = 1.0
    for _ in range(LEVELS):
        meets = 1 - (1 - similarity * meets) ** CHILDREN
    runs, missed = 1, 1 - meets
    while 1 - missed**runs < recall:
        runs += 1
    return runs


def shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's start. Fewer words than a shingle make one."""
    docs = len(words.first) - 1
    counts = words.counts
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(docs), each)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    full = window_hashes(words.hashes, width)
    values = np.zeros(len(doc), np.uint64)
    long = counts[doc] >= width
    values[long] = full[at[long]]
    for i in np.flatnonzero(~long).tolist():
        start, to = int(at[i]), int(at[i] + counts[doc[i]])
        values[i] = window_hashes(words.hashes[start:to], to - start)[0]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(docs + 1))


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least hash at each place, per non-empty document (a row)."""
    filled = np.flatnonzero(np.diff(first))
    result = np.empty((len(filled), PLACES), np.uint32)
    for place in range(PLACES):
        hashed = mix(values ^ mix(np.array([place + 1], np.uint64))[0]) >> np.uint64(32)
        result[:, place] = np.minimum.reduceat(hashed, first[filled]) if len(filled) else 0
    return result


def _set_rows(block: pa.RecordBatch) -> pa.RecordBatch:
    values, first = shingles(split_words(block.column(2)))
    filled = np.flatnonzero(np.diff(first))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
    key = mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64))
    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * PLACES), len(filled), [None, pa.py_buffer(sketches(values, first).tobytes())]).cast(pa.binary())
    index = np.full(block.num_rows, -1)
    index[filled] = np.arange(len(filled))
    return pa.RecordBatch.from_arrays(
        [*block.columns[:2], block.column(3), block.column(4), pa.array(key.view(np.int64), mask=index < 0), sketch.take(pa.array(index, mask=index < 0))], ["place", "mark", "doc_id", "bytes", "id", "sketch"]
    )


def _matrix(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint32).reshape(-1, PLACES)


def _children(paths: np.ndarray) -> np.ndarray:
    """The places that each path's node samples: those with the least hashes."""
    score = mix(paths[:, None] ^ mix(np.arange(1, PLACES + 1, dtype=np.uint64))[None, :])
    return np.argpartition(score, CHILDREN, axis=1)[:, :CHILDREN]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Send each ``(path, id, sketch)`` to its node's children."""
    for batch in batches:
        path = batch.column(0).to_numpy().view(np.uint64)
        matrix = _matrix(batch.column(2))
        distinct, of = np.unique(path, return_inverse=True)
        places = _children(distinct)[of]
        value = np.take_along_axis(matrix, places, axis=1).astype(np.uint64)
        child = join_hashes(np.repeat(path, CHILDREN), (value * np.uint64(PLACES) + places.astype(np.uint64)).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(np.repeat(np.arange(len(path)), CHILDREN)))], ["path", "id"])


def _roots(matrix_equal: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(matrix_equal))
    matrix_equal = matrix_equal | np.eye(len(label), dtype=bool)
    while True:
        after = np.where(matrix_equal, label[None, :], len(label)).min(axis=1)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _candidates(table: pa.Table, similarity: float = SIMILARITY) -> pa.Table:
    """Stars of the sets in a bucket (or pair of chunks) whose sketches may be similar."""
    _, once = np.unique(table.column("id").to_numpy(), return_index=True)
    table = table.take(pa.array(once))
    ids = table.column("id").to_numpy()
    matrix = _matrix(table.column("sketch"))
    agree = np.zeros((len(ids), len(ids)), np.uint8)
    for place in range(PLACES):
        column = matrix[:, place]
        agree += column[:, None] == column[None, :]
    root = _roots(agree >= PLACES * (similarity - MARGIN))
    linked = root != np.arange(len(ids))
    return pa.table({"a": ids[linked], "b": ids[root[linked]]})


def _chunk_pairs(rows: DataFrame, chunks: Column) -> DataFrame:
    """Deal a large group's rows to chunks and send each row to all pairs of chunks that hold its own."""
    own = F.pmod(F.xxhash64("id", F.lit(11)), F.col("_chunks")).cast("int")
    rows = rows.withColumn("_chunks", chunks).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    return rows.withColumn("_other", other).withColumn("_one", F.least("_own", "_other")).withColumn("_two", F.greatest("_own", "_other")).drop("_other", "_chunks")


def candidate_groups(sets: DataFrame, runs: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``id, root`` of all sets that may be similar to another, by the chosen-path recursion."""
    start = mix(np.arange(1, (runs or runs_for(similarity=similarity - 0.1)) + 1, dtype=np.uint64)).view(np.int64).tolist()
    sketch = sets.select("id", "sketch")
    nodes = sketch.select(F.explode(F.array(*map(F.lit, start))).alias("path"), "id", "sketch")
    stars = None

    def candidates(table: pa.Table) -> pa.Table:
        return _candidates(table, similarity)

    for level in range(LEVELS):
        paths = written(nodes.select("path", "id", "sketch").mapInArrow(_split, "path long, id long"), "paths")
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        filled = written(paths.join(sizes, "path"), "buckets")
        last = level == LEVELS - 1
        leaves = (filled if last else filled.where(F.col("size") <= BUCKET)).join(sketch.hint("merge"), "id")
        dealt = _chunk_pairs(leaves, F.ceil(F.col("size") / BUCKET).cast("int"))
        found = dealt.groupBy("path", "_one", "_two").applyInArrow(candidates, "a long, b long")
        found = written(found.distinct(), "stars")
        stars = found if stars is None else stars.unionByName(found)
        if last or not filled.where(F.col("size") > BUCKET).take(1):
            break
        nodes = filled.where(F.col("size") > BUCKET).select("path", "id").join(sketch.hint("merge"), "id")
    return components(stars)


def _compare(limit: Fraction):
    def compare(table: pa.Table) -> pa.Table:
        """Exact links of the sets of a group (or between two chunks): degree and component of each."""
        _, once = np.unique(table.column("id").to_numpy(), return_index=True)
        table = table.take(pa.array(once))
        ids, own = table.column("id").to_numpy(), table.column("_own").to_numpy()
        one, two = table.column("_one")[0].as_py(), table.column("_two")[0].as_py()
        values, first = shingles(split_words(table.column("text")))
        size = np.diff(first)
        doc = np.repeat(np.arange(len(ids)), size)
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        doc, column = doc[shared], column[shared]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)  # exact: counts below 2^24
        number = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
        for begin in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            a, b = np.searchsorted(number, [begin, begin + 4096])
            present = np.zeros((len(ids), 4096), np.float32)
            present[doc[a:b], number[a:b] - begin] = 1
            both += present @ present.T
        union = size[:, None] + size[None, :] - both
        link = both * limit.denominator >= union * limit.numerator
        np.fill_diagonal(link, False)
        if one != two:  # pairs inside a chunk belong to that chunk's own task
            link &= own[:, None] != own[None, :]
        root = _roots(link)
        return pa.table({"id": ids, "root": ids[root], "links": link.sum(axis=1).astype(np.int64)})

    return compare


def set_texts(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, text`` of the document that stands for each candidate set.

    The sets grow with the corpus, so texts are shuffled at every size, here and in the other joins that carry texts or
    sketches: a small corpus gives no other plan than a large one.
    """
    return placed.select("place", "mark", "text").join(groups.select("id", "place", "mark").hint("merge"), ["place", "mark"]).select("id", "text")


def similar_sets(texts: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, root, links`` rows of all candidate sets: exact links by chunk pair of their group."""
    limit = Fraction(similarity).limit_denominator(10_000)
    size = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BUCKET), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("size"))
    members = texts.join(groups.join(size, "root").hint("merge"), "id")
    dealt = _chunk_pairs(members, F.greatest("size", F.lit(1))).select("id", "text", "root", "_own", "_one", "_two")
    return dealt.groupBy("root", "_one", "_two").applyInArrow(_compare(limit), "id long, root long, links long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: ``place, mark, doc_id, class_set, class_id, n_links, n_copies``.

    ``class_id`` is the smallest ``doc_id`` of all documents connected by links; ``n_links`` the number of different
    shingle sets that are similar to the document's; ``n_copies`` the number of documents that have its very set.
    A text without words is linked to nothing and is its own class (null where it has no id), also when repeated.
    Null ids count as the largest; repeated rows are copies; an empty table gives no rows. Texts of any length are read
    whole. A similarity equal to the limit is a link. Other columns, whatever their names, are not read.
    """
    text = F.col("text").cast("string")
    placed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), F.hash(text).alias("mark"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"))
    rows = written(map_text(placed, _set_rows, "place long, mark int, doc_id long, bytes long, id long, sketch binary"), "sets")
    sets = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("place").alias("place"), F.min_by("mark", F.struct("place", "mark")).alias("mark"), F.count(F.lit(1)).alias("n_copies"), F.first("sketch").alias("sketch"), F.max("bytes").alias("bytes"))
    sets = written(sets, "distinct-sets")
    groups = written(candidate_groups(sets, similarity=similarity).join(sets.select("id", "place", "mark", "bytes"), "id"), "groups")
    found = written(similar_sets(set_texts(placed, groups), groups.select("id", "root", "bytes"), similarity), "links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    known = sets.select("id", "place", "n_copies").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = known.groupBy("root").agg(F.min("place").alias("class_id"))
    known = known.join(smallest, "root").select("id", F.col("root").alias("class_set"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    joined = rows.select("place", "mark", "doc_id", "id").join(known, "id", "left")
    alone = F.col("id").isNull()
    return joined.select(
        "place", "mark", "doc_id", "class_set",
        F.nullif(F.when(alone, F.col("place")).otherwise(F.col("class_id")), F.lit((1 << 63) - 1)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest id; texts without words all stay."""
    found = written(near_duplicates(docs).where("class_set IS NOT NULL").select("place", "mark", "class_set"), "classes")
    lead = found.groupBy("class_set").agg(F.min(F.struct("place", "mark")).alias("_lead")).select("_lead.*")
    lead = written(lead.distinct(), "leads")
    text = F.col("text").cast("string")
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), F.hash(text).alias("mark"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key)
    kept = rows.join(lead.hint("merge"), ["place", "mark"])
    if found.groupBy("place", "mark").count().where("count > 1").take(1):  # repeated rows: one of them
        kept = kept.dropDuplicates(["place", "mark"])
    empty = docs.where(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)).unionByName(empty)
