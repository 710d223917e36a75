"""Licences of files: TF-IDF cosine of their passages to templates, then inheritance along paths.

Templates are statements, file headers, licence texts and machine-readable tags. A template of n words is compared
with every n consecutive words of a file, whatever lines they stand on and whatever comment marks stand between them;
the best passage at or above a threshold is the file's own licence. A file that is mostly such a passage, or is named
like one, is a licence file and speaks for its directory. A file without own licence takes that of the nearest
directory above it, found by joining each distinct directory's ancestors with the directories that have one.

Words are weighed by their inverse document frequency in the whole corpus, counted by hash in a table that grows as
the corpus's distinct words do. Passages that cannot reach the threshold are never looked at: one that does holds at
least one of the few words that make up most of the template's length (``Template.telling``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.licence_texts import TEMPLATES
from evq.llm.quality import number_of_buckets
from evq.llm.tasks import map_text, small_batches, written
from evq.llm.words import ALNUM_WORDS, Words, release_memory, split_words, text_blocks

#: Least cosine of a passage to a template; share of a licence file's words in its licence passage.
SIMILARITY = 0.6
FILE_SHARE = 1 / 3
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
#: Words of candidate passages that are handled at once.
PASSAGE_WORDS = 1 << 20


class Template(NamedTuple):
    """A template's words: their hashes, sorted, and count times idf of each; its length in words and as a vector."""

    licence: str
    hashes: np.ndarray
    weights: np.ndarray
    words: int
    norm: float
    telling: np.ndarray  # hashes of the words without which no passage reaches the threshold


def hashed_words(column: pa.Array) -> Words:
    return split_words(column, ALNUM_WORDS, lower=True)


def idf_of(hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(hashes & np.uint64(len(idf) - 1)).astype(np.int64)]


class Matcher:
    def __init__(self, idf: np.ndarray):
        self.idf = idf
        words = hashed_words(pa.array([text for _, text in TEMPLATES]))
        self.templates = []
        for i, (licence, _) in enumerate(TEMPLATES):
            hashes, count = np.unique(words.hashes[words.first[i] : words.first[i + 1]], return_counts=True)
            weights = count * idf_of(hashes, idf)
            norm = float(np.linalg.norm(weights))
            order = np.argsort(-weights, kind="stable")
            # Without the first k words the cosine is at most the length of the rest: take k so that it is too short.
            rest = np.sqrt(np.maximum(1 - np.cumsum((weights[order] / norm) ** 2), 0))
            enough = int(np.argmax(rest < SIMILARITY - 1e-9)) + 1
            self.templates.append(Template(licence, hashes, weights, int(count.sum()), norm, np.sort(hashes[order[:enough]])))
        self.vocabulary = np.unique(np.concatenate([t.hashes for t in self.templates]))

    def best(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: the number of the template of its best passage (ties: the first), the cosine and the passage's words."""
        docs = len(words.first) - 1
        found, score, length = np.full(docs, -1), np.zeros(docs), np.zeros(docs, np.int64)
        if not len(words.hashes):
            return found, score, length
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words.hashes)
        term = at[known]
        idf = idf_of(words.hashes, self.idf)
        squares = np.concatenate([[0.0], np.cumsum(idf**2)])
        owner = np.repeat(np.arange(docs), words.counts)
        for number, template in enumerate(self.templates):
            place = np.searchsorted(self.vocabulary, template.hashes)
            telling = np.zeros(len(self.vocabulary), bool)
            telling[np.searchsorted(self.vocabulary, template.telling)] = True
            hits = known[telling[term]]
            if not len(hits):
                continue
            begin, end = words.first[owner[hits]], words.first[owner[hits] + 1]
            lowest = np.maximum(begin, hits - template.words + 1)
            highest = np.minimum(hits, np.maximum(begin, end - template.words))
            starts = np.unique(_ranges(np.minimum(lowest, highest), highest + 1))
            ends = np.minimum(starts + template.words, words.first[owner[starts] + 1])
            weight = np.zeros(len(self.vocabulary))
            weight[place] = template.weights
            gain = np.zeros(len(words.hashes))
            gain[known] = weight[term] * idf[known]
            total = np.concatenate([[0.0], np.cumsum(gain)])
            dot = total[ends] - total[starts]
            # Equal words only lengthen a passage's vector, so this is a bound.
            able = dot >= (SIMILARITY - 1e-6) * template.norm * np.sqrt(squares[ends] - squares[starts])
            starts, ends, dot = starts[able], ends[able], dot[able]
            step = max(1, PASSAGE_WORDS // template.words)
            for i in range(0, len(starts), step):
                part = slice(i, i + step)
                norm = _norms(words.hashes, idf, starts[part], ends[part], template.words)
                cosine = np.round(dot[part] / (norm * template.norm), 9)
                doc = owner[starts[part]]
                for j in np.lexsort((starts[part], -cosine, doc)).tolist():
                    if cosine[j] > score[doc[j]]:
                        found[doc[j]], score[doc[j]], length[doc[j]] = number, cosine[j], ends[part][j] - starts[part][j]
        return found, np.minimum(score, 1.0), length


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _norms(hashes: np.ndarray, idf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Length of each passage's vector of counts times idf."""
    at = starts[:, None] + np.arange(words)[None, :]
    inside = at < ends[:, None]
    at = np.where(inside, at, starts[:, None])
    word, weight = hashes[at], np.where(inside, idf[at], 0.0)
    order = np.argsort(word, axis=1, kind="stable")
    word, weight = np.take_along_axis(word, order, axis=1), np.take_along_axis(weight, order, axis=1)
    new = np.ones(word.shape, bool)
    new[:, 1:] = word[:, 1:] != word[:, :-1]
    run = np.cumsum(new.reshape(-1)) - 1
    summed = np.bincount(run, weight.reshape(-1))
    row = np.repeat(np.arange(len(starts)), new.sum(axis=1))
    return np.sqrt(np.bincount(row, summed**2, minlength=len(starts)))


def inverse_frequencies(files: DataFrame) -> np.ndarray:
    """Idf of every place of the hash table, from all files; one row per place and task is shuffled."""
    texts = files.select(F.col("text").cast("string").alias("text"))
    size = number_of_buckets(texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in text_blocks(batch, "text"):
                words = hashed_words(block.column(0))
                owner = np.repeat(np.arange(block.num_rows), words.counts)
                pair = np.unique(owner * size + (words.hashes & np.uint64(size - 1)).astype(np.int64))
                found += np.bincount(pair % size, minlength=size)
            release_memory()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], rows))], ["place", "n"])

    summed = small_batches(texts).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = (summed.column(i).to_numpy() for i in (0, 1))
    frequency = np.zeros(size)
    frequency[place[place >= 0]] = n[place >= 0]
    return np.log((1 + n[place < 0].sum()) / (1 + frequency)) + 1


def own_licences(files: DataFrame) -> DataFrame:
    """Per file of ``(path, text, ...)``: its columns but ``text``, with ``own_licence``, ``own_score`` and ``licence_share``."""
    sent = files.sparkSession.sparkContext.broadcast(Matcher(inverse_frequencies(files)))
    keep = [c for c in files.columns if c != "text"]
    schema = files.select(*keep).schema.add("own_licence", "string").add("own_score", "double").add("licence_share", "double")
    names = np.array([name for name, _ in TEMPLATES] + [None], dtype=object)

    def match(block: pa.RecordBatch) -> pa.RecordBatch:
        get = {name: block.column(i) for i, name in enumerate(block.schema.names)}
        words = hashed_words(get["text"])
        template, score, length = sent.value.best(words)
        hit = score >= SIMILARITY
        licence = names[np.where(hit, template, -1)]
        share = np.where(hit, length / np.maximum(words.counts, 1), 0.0)
        return pa.RecordBatch.from_arrays([*(get[k] for k in keep), pa.array(licence.tolist(), pa.string()), pa.array(np.where(hit, score, 0.0)), pa.array(share)], schema.fieldNames())

    return map_text(files.withColumn("text", F.col("text").cast("string")), match, schema)


def scan(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``text`` and others): all columns but the text, with ``own_licence, own_score, licence,
    licence_from`` (``own``, ``inherited`` or null) and ``inherited_path``, the licence file.

    A null or empty text has no own licence, and ``own_score`` is 0 without one; very long texts are read whole; of
    equally good passages the template that is listed first counts; a null path has no directory and inherits nothing;
    of several licence files of a directory the one of highest score speaks for it, on ties that of the smallest path;
    repeated rows give equal rows; the result's columns replace input columns of those names; an empty table gives no rows.
    """
    clash = [c for c in files.columns if c in ("own_licence", "own_score", "licence", "licence_from", "inherited_path", "licence_share", "_dir")]
    own = written(own_licences(files.drop(*clash)), "licences").withColumn("_dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    stated = own.where(F.col("own_licence").isNotNull() & F.col("path").isNotNull() & ((F.col("licence_share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAMES)))
    spoken = stated.groupBy("_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_licence").alias("l"))).alias("_best"))
    spoken = spoken.select(F.col("_dir").alias("_above"), F.col("_best.l").alias("_licence"), F.col("_best.p").alias("_path"))
    # every ancestor of each distinct directory: its path cut after each part, the root (empty) included
    parts = F.split("_dir", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts)))
    above = own.where("path IS NOT NULL AND own_licence IS NULL").select("_dir").distinct().withColumn("_depth", depth)
    above = above.withColumn("_above", F.array_join(F.slice(parts, F.lit(1), F.col("_depth")), "/"))
    nearest = above.join(spoken, "_above").groupBy("_dir").agg(F.max(F.struct("_depth", "_licence", "_path")).alias("_near"))
    found = own.join(nearest, "_dir", "left")
    mine = F.col("own_licence").isNotNull()
    return found.select(
        *[c for c in files.columns if c != "text" and c not in clash],
        "own_licence",
        "own_score",
        F.coalesce("own_licence", F.col("_near._licence")).alias("licence"),
        F.when(mine, "own").when(F.col("_near").isNotNull(), "inherited").alias("licence_from"),
        F.when(~mine, F.col("_near._path")).alias("inherited_path"),
    )
