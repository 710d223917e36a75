"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled documents, indexed with all their words; document frequencies come from all
documents. A word's TF-IDF weight is multiplied by its association with the label among the examples, so that a few
telling words outweigh hundreds of others; no word is left out, so a document that resembles an example in any words
finds it. Inverted lists are cut into blocks of examples with the largest weight of each word in each block: a query
takes the blocks in order of their bounds, reads the postings of those alone that can still hold one of its nearest
examples, and gets the exact list by cosine. The weights of common words, whose
lists are rather full, stand in plain rows of each block instead of postings, and are multiplied for many queries at
once. Words of little association carry little of a vector: the lists of the others leave few examples that can be among
the nearest, and these alone get the rest of their cosine from rows of their own; where they leave many, all lists are
read. Votes are weighed by similarity and mapped
to probabilities on leave-one-out votes of the examples themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import map_text, small_batches
from evq.llm.words import ALNUM_WORDS, split_words, text_blocks

#: Labelled documents at most of each label that serve as examples.
EXAMPLES = 4000
#: A word's weight is multiplied by BASE plus what its chi-squared statistic exceeds CHANCE by (one in twenty does by chance).
BASE = 0.05
CHANCE = 3.84
NEIGHBOURS = 25
BLOCK = 256
#: A word in at least this share of the examples (of BLOCK, if they are fewer) is common; its rows take at most 2 / COMMON cells a posting.
COMMON = 1/16
#: A word whose association is at most this is light: its postings are read only where the other words leave many examples.
LIGHT = 0.5
#: Queries whose common words are multiplied at once.
TOGETHER = 64
FOLDS = 5
#: Weight of the examples' overall share in a vote.
PRIOR = 0.5


class Vectors(NamedTuple):
    """Sparse rows of unit length: ``terms[first[i]:first[i + 1]]`` and their weights."""

    terms: np.ndarray
    weights: np.ndarray
    first: np.ndarray


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term hash and count of all distinct terms of each document."""
    words = split_words(column, ALNUM_WORDS, lower=True)
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts)
    order = np.lexsort((words.hashes, doc))
    term, doc = words.hashes[order], doc[order]
    fresh = np.ones(len(term), dtype=bool)
    fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], term[at], np.diff(np.append(at, len(term)))


def chosen_counts(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``term_counts``, for the terms of a sorted vocabulary, by their places in it."""
    words = split_words(column, ALNUM_WORDS, lower=True)
    docs = len(words.first) - 1
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == words.hashes
    doc = np.repeat(np.arange(docs), words.counts)[known]
    pair, count = np.unique(doc * len(vocabulary) + at[known], return_counts=True)
    doc, term = np.divmod(pair, len(vocabulary))
    return doc, term, count


def unit_vectors(doc: np.ndarray, term: np.ndarray, count: np.ndarray, scale: np.ndarray, docs: int) -> Vectors:
    weight = (1 + np.log(count)) * scale[term] if len(term) else np.zeros(0)
    norm = np.sqrt(np.bincount(doc, weight**2, minlength=docs))
    return Vectors(term, weight / norm[doc] if len(doc) else weight, np.searchsorted(doc, np.arange(docs + 1)))


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, end), one range after the other, and the number of each one's range."""
    lengths = ends - starts
    of = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(of)) + (starts - np.cumsum(lengths) + lengths)[of], of


class BlockMaxIndex:
    """Inverted lists of unit vectors, cut into blocks of ``BLOCK`` vectors, with the largest weight of each piece.

    Light terms, if any are named, also stand in plain rows, with the length of each vector's light part. The product of
    the light parts of a query and a vector is at most that of their lengths: the lists of the other terms leave few
    vectors, and these alone get their light terms.
    """

    def __init__(self, vectors: Vectors, terms: int, light: np.ndarray | None = None):
        self.size = len(vectors.first) - 1
        self.blocks = max(1, -(-self.size // BLOCK))
        self.light = np.zeros(terms, bool) if light is None else light
        # vectors stand in ascending order, so a stable sort by term leaves them so
        order = np.argsort(vectors.terms, kind="stable")
        term, self.weights = vectors.terms[order], vectors.weights[order]
        self.rows = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(vectors.first))[order]
        del order
        block = self.rows // BLOCK
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.largest = np.maximum.reduceat(self.weights, start) if len(term) else np.zeros(0)
        self.first, self.block = np.searchsorted(term[start], np.arange(terms + 1)), block[start]
        self.lengths = np.diff(np.append(start, len(term))).astype(np.int32)
        self.postings_read = 0
        # plain rows of common words, and postings of the others
        self.frequency = np.bincount(term, minlength=terms)
        often = (self.frequency >= max(self.size, BLOCK) * COMMON) & ~self.light
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        self.table = np.zeros((self.blocks, int(often.sum()), BLOCK))
        full = often[term]
        self.table[block[full], self.common[term[full]], self.rows[full] % BLOCK] = self.weights[full]
        self.start = np.concatenate([[0], np.cumsum(np.where(often[term[start]], 0, self.lengths))])
        del term, block, start
        self.rows, self.weights = self.rows[~full], self.weights[~full]
        del full
        # vectors with their light terms, frequent ones numbered first so that they lie together, and the length of these
        self.number = np.empty(terms, np.int32)
        self.number[np.argsort(-self.frequency, kind="stable")] = np.arange(terms)
        here = self.light[vectors.terms]
        self.light_terms, self.light_weights = self.number[vectors.terms[here]], vectors.weights[here]
        self.light_first = np.concatenate([[0], np.cumsum(here)])[vectors.first]
        row = np.repeat(np.arange(self.size), np.diff(self.light_first))
        self.light_length = np.zeros((self.blocks, BLOCK))
        self.light_length.reshape(-1)[: self.size] = np.sqrt(np.bincount(row, self.light_weights**2, minlength=self.size))
        self.light_longest = self.light_length.max(axis=1)
        self.query = np.zeros(terms)  # by number; zeros between two searches

    def begun(self, queries: Vectors) -> np.ndarray:
        """Products of queries and all vectors in the common words: block, query, vector."""
        at = self.common[queries.terms]
        row = np.repeat(np.arange(len(queries.first) - 1), np.diff(queries.first))
        dense = np.zeros((len(queries.first) - 1, self.table.shape[1]))
        dense[row[at >= 0], at[at >= 0]] = queries.weights[at >= 0]
        return dense @ self.table

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` vectors of largest cosine above 0 (ties: the smaller row first) and their cosines.

        ``begun`` is the query's part of :meth:`begun`; without it, common words are read in the blocks that matter.
        """
        if begun is not None:
            telling = self.common[terms] < 0
            terms, weights = terms[telling], weights[telling]
        light = self.light[terms]
        if not light.any() or (cosine := self._completed(terms, weights, light, k, without, begun)) is None:
            cosine, _ = self._read(terms, weights, k, without, begun)
        found = np.flatnonzero(cosine >= 1e-12)
        if len(found) > k:  # copies may differ in the last bits
            found = found[cosine[found] >= np.partition(cosine[found], -k)[-k] - 1e-12]
        found = found[np.lexsort((found, -np.round(cosine[found], 12)))][:k]
        return found, np.minimum(cosine[found], 1.0)

    def _completed(self, terms: np.ndarray, weights: np.ndarray, light: np.ndarray, k: int, without: int, begun: np.ndarray | None) -> np.ndarray | None:
        """Cosines of the vectors that can be among the ``k`` nearest, 0 of others; None where their rows are longer than the lists."""
        rest = float(np.sqrt(weights[light] @ weights[light]))
        flat, worst = self._read(terms[~light], weights[~light], k, without, begun, rest)
        able = np.flatnonzero(flat + rest * self.light_length.reshape(-1) >= worst * (1 - 1e-9))
        able = able[(able < self.size) & (able != without)]
        starts, ends = self.light_first[able], self.light_first[able + 1]
        if int((ends - starts).sum()) > int(self.frequency[terms[light]].sum()) + len(flat):
            return None
        at, of = spans(starts, ends)
        self.postings_read += len(at)
        own = self.number[terms[light]]
        self.query[own] = weights[light]
        cosine = np.zeros(len(flat))
        cosine[able] = flat[able] + np.bincount(of, self.light_weights[at] * self.query[self.light_terms[at]], minlength=len(able))
        self.query[own] = 0
        return cosine

    def _read(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int, begun: np.ndarray | None, rest: float = 0.0) -> tuple[np.ndarray, float]:
        """Products with all vectors of the blocks that can hold one of the ``k`` nearest, and the ``k``-th largest of them.

        ``rest`` is the length of the part of the query that is in neither the terms nor ``begun``: its light terms.
        """
        pieces, of = spans(self.first[terms], self.first[terms + 1])
        block, weight = self.block[pieces], weights[of]
        bound = np.bincount(block, self.largest[pieces] * weight, minlength=self.blocks) + rest * self.light_longest
        if begun is not None:
            bound += begun.max(axis=1)
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(self.blocks, np.int16)  # small integers sort fast
        rank[order] = np.arange(self.blocks)
        place = rank[block]
        by_rank = np.argsort(place, kind="stable")
        pieces, weight = pieces[by_rank], weight[by_rank]
        edges = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=self.blocks))])
        often = self.common[terms] >= 0
        common, of_common = self.common[terms[often]], weights[often]
        cosine, done, step, worst, top = np.zeros((self.blocks, BLOCK)), 0, 2 + k // BLOCK, 0.0, np.zeros(k)
        flat = cosine.reshape(-1)
        while True:
            able = int(np.searchsorted(-bound[order], -max(worst, 1e-12) * (1 - 1e-12), side="right"))
            to = min(able, done + step)
            if to <= done:
                break
            chosen = slice(edges[done], edges[to])
            here = pieces[chosen]
            self.postings_read += int(self.lengths[here].sum())
            at, piece = spans(self.start[here], self.start[here + 1])
            flat += np.bincount(self.rows[at], self.weights[at] * weight[chosen][piece], minlength=len(flat))
            if begun is not None:
                cosine[order[done:to]] += begun[order[done:to]]
            for b in order[done:to] if len(common) else ():
                cosine[b] += of_common @ self.table[b][common]
            if without >= 0:
                flat[without] = 0
            new = cosine[order[done:to]].reshape(-1)
            top = np.partition(np.concatenate([top, new[new > worst]]), -k)[-k:]
            worst = top[0]
            done, step = to, 4 * step
        return flat, worst


class Model(NamedTuple):
    vocabulary: np.ndarray
    scale: np.ndarray  # of each word: inverse document frequency times association
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    share: float
    blank_share: float
    votes: np.ndarray  # calibration: vote ...
    odds: np.ndarray  # ... and probability


def vote(model: Model, terms: np.ndarray, weights: np.ndarray, without: int = -1, begun: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Share of toxic among the nearest examples, weighed by similarity; those that share nothing have no say."""
    if not len(terms) or not model.index.size:
        return model.blank_share, np.zeros(0, np.int64)
    found, cosine = model.index.nearest(terms, weights, NEIGHBOURS, without, begun)
    if not len(found):
        return model.blank_share, found
    pull = cosine**2
    return float((pull @ model.labels[found] + PRIOR * model.share) / (pull.sum() + PRIOR)), found


def votes_of(model: Model, queries: Vectors, rows: np.ndarray, themselves: bool = False) -> Iterator[tuple[float, np.ndarray]]:
    """:func:`vote` of some of the queries, which may be the examples themselves."""
    for done in range(0, len(rows), TOGETHER):
        some = rows[done : done + TOGETHER]
        at, of = spans(queries.first[some], queries.first[some + 1])
        mine = Vectors(queries.terms[at], queries.weights[at], np.searchsorted(of, np.arange(len(some) + 1)))
        begun = model.index.begun(mine)
        for i, row in enumerate(some.tolist()):
            own = slice(mine.first[i], mine.first[i + 1])
            yield vote(model, mine.terms[own], mine.weights[own], row if themselves else -1, begun[:, i])


def calibrated(model: Model, votes: np.ndarray) -> np.ndarray:
    if not len(model.votes):
        return votes
    return np.clip(0.99 * np.interp(votes, model.votes, model.odds) + 0.01 * votes, 0, 1)


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: the vote and the label's weighted mean of each pool."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist(), strict=True):
        pools.append([y * w, w, v * w])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], a, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _example_ids(labels: DataFrame) -> dict[int, int]:
    """At most ``EXAMPLES`` labelled ids of each label outside the held-out fold, by a hash; the larger label wins where rows differ."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    found: dict[int, int] = {}
    for label in (0, 1):
        found |= {r[0]: label for r in rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).collect()}
    return found


def association(terms: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """The factor of each term, from the terms of each example (one per pair) and whether that example is toxic."""
    n1 = float(toxic.sum())
    n0 = len(toxic) - n1
    a, every = np.bincount(terms[0], toxic[terms[1]], minlength=size), np.bincount(terms[0], minlength=size)
    b, n = every - a, n0 + n1
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(n0 * n1 * every * (n - every), 1e-9)
    return BASE + np.maximum(chi - CHANCE, 0)


def document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each word of a sorted vocabulary."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in text_blocks(batch, "text"):
                np.add.at(found, chosen_counts(block.column(0), sent.value)[1], 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], rows))], ["term", "n"])

    summed = small_batches(texts).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (summed.column(i).to_numpy() for i in (0, 1))
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), frequency


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Take the examples' words, count documents, index the examples and calibrate their votes.

    To the driver come at most ``2 * EXAMPLES`` ids, as many sparse vectors, and the number of documents of each of
    their words; an id that many rows carry is one example, with the smallest of its texts.
    """
    spark = docs.sparkSession
    wanted = _example_ids(labels)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = spark.createDataFrame(list(wanted.items()), "doc_id long, toxic int")  # bounded: 2 * EXAMPLES rows
    examples = chosen.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # the share of toxic among labelled rows, which the equal-sized samples hide
    shares = dict(labels.where(F.col("toxic").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).groupBy("toxic").count().collect())
    share = shares.get(1, 0) / max(1, shares.get(0, 0) + shares.get(1, 0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                doc, term, count = term_counts(block.column(1))
                first = np.searchsorted(doc, np.arange(block.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (term.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), *lists], ["doc_id", "toxic", "terms", "counts"])

    rows = small_batches(examples).mapInArrow(vectors, "doc_id long, toxic int, terms array<long>, counts array<int>").toArrow().combine_chunks()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(np.float64)
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    if not n0 or not n1:
        nothing = BlockMaxIndex(Vectors(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)), 0)
        return Model(np.zeros(0, np.uint64), np.zeros(0), nothing, np.zeros(0), np.zeros(0, np.int64), share, share, np.zeros(0), np.zeros(0))
    lengths = pc.list_value_length(rows.column("terms")).to_numpy()
    hashes, counts = (pc.list_flatten(rows.column(name)).to_numpy() for name in ("terms", "counts"))
    vocabulary, term = np.unique(hashes.view(np.uint64), return_inverse=True)
    term, doc = term.astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    del rows, hashes  # here and below: the driver holds few arrays of all words at a time
    documents, frequency = document_frequencies(chosen.select("text"), vocabulary)
    factor = association((term, doc), toxic, len(vocabulary))
    scale = (np.log((1 + documents) / (1 + frequency)) + 1) * factor
    # Examples beside those with the same strongest word, so that they share blocks; ties by id.
    plain = unit_vectors(doc, term, counts, scale, len(ids))
    strongest = np.full(len(ids), -1)
    by_weight = np.lexsort((plain.weights, doc))
    strongest[doc[by_weight]] = term[by_weight]
    del plain, by_weight
    place = np.lexsort((ids, strongest))
    rank = np.empty(len(ids), np.int64)
    rank[place] = np.arange(len(ids))
    moved = np.lexsort((term, rank[doc]))
    found = unit_vectors(rank[doc][moved], term[moved], counts[moved], scale, len(ids))
    del moved, term, doc, counts
    ids, toxic = ids[place], toxic[place]
    # examples stand for all labelled rows of their label
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0)
    blank = np.diff(found.first) == 0
    blank_share = float((weight * toxic)[blank].sum() / weight[blank].sum()) if blank.any() else share
    model = Model(vocabulary, scale, BlockMaxIndex(found, len(vocabulary), factor <= LIGHT), toxic, ids, float(toxic.mean()), blank_share, np.zeros(0), np.zeros(0))
    full = np.flatnonzero(~blank)
    probes = full[np.argsort(np.array([zlib.crc32(b"%d" % ids[i]) for i in full]))][:CALIBRATION]
    votes = np.array([value for value, _ in votes_of(model, found, probes, themselves=True)])
    if not len(votes):
        return model
    points = isotonic(votes, toxic[probes], weight[probes])
    return model._replace(votes=points[0], odds=points[1])


#: Examples whose leave-one-out votes calibrate the scores.
CALIBRATION = 2000


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` and ``evidence``, the ids of up to three nearest examples.

    A null or empty text, and one without any word of an example, gets the share of toxic among examples without words,
    or among all. Very long texts are read whole. Equally near examples are taken in the order of the index. Without
    examples of both labels every score is the labels' share of toxic (0 without labels). Repeated rows get equal
    scores; a null ``doc_id`` is in no fold, its ``held_out`` is false; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(block: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = sent.value, block.num_rows
        doc, term, count = chosen_counts(block.column(1), model.vocabulary)
        found = unit_vectors(doc, term, count, model.scale, rows)
        seen: dict[bytes, int] = {}  # equal documents are searched once
        keys = [found.terms[a:b].tobytes() + found.weights[a:b].tobytes() for a, b in zip(found.first, found.first[1:])]
        of = np.array([seen.setdefault(key, row) for row, key in enumerate(keys)], np.int64)
        each, of = np.unique(of, return_inverse=True)
        searched = [(value, model.ids[near[:3]].tolist()) for value, near in votes_of(model, found, each)]
        votes, evidence = np.array([value for value, _ in searched])[of], [searched[i][1] for i in of]
        blank = np.diff(found.first) == 0
        scores = np.where(blank, model.blank_share, calibrated(model, votes))
        ids = block.column(0)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
            ["doc_id", "held_out", "score", "predicted", "evidence"],
        )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(chosen, score, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
