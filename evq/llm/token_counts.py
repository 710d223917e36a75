"""Token counts under a unigram vocabulary, without encoding any text twice.

The best segmentation of a pre-token maximises the sum of its pieces' log
probabilities. Distinct pre-tokens of a block are put in order, which walks their
trie depth first: forward scores of a prefix are computed once for all words that
share it, and what is stored for a word is the number of pieces at its end. A
worker remembers the counts of words it has met.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.tasks import map_text
from evq.llm.words import split_words

#: Words a worker remembers (16 bytes each).
MEMORY_ENTRIES = 2_000_000
_MARK = "▁"


class Unigram:
    """Pieces and their log probabilities; a character no piece covers costs one piece a byte."""

    _made: dict[str, Unigram] = {}

    @classmethod
    def get(cls, path: str) -> Unigram:
        if path not in cls._made:
            cls._made[path] = cls.from_file(path)
        return cls._made[path]

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """Pieces of a public vocabulary file. It ranks pieces by frequency and holds no probabilities: those follow Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        total = math.log(sum(1 / (rank + 1) for rank in range(len(normal))))
        return cls({model.id_to_piece(i): -math.log(rank + 1) - total for rank, i in enumerate(normal)})

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def terminal_counts(self, words: Iterable[str]) -> list[int]:
        """Pieces of the best segmentation of each of the given words, which must be in ascending order."""
        pieces, longest, unknown = self.pieces, self.longest, self.unknown
        score, count, previous = [0.0], [0], ""
        result = []
        for word in words:
            shared, end = 0, min(len(previous), len(word))
            while shared < end and word[shared] == previous[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                width = len(word[at - 1].encode())
                best, least = score[at - 1] + unknown * width, count[at - 1] + width
                for start in range(max(0, at - longest), at):
                    piece = pieces.get(word[start:at])
                    if piece is not None:
                        value = score[start] + piece
                        if value > best or (value == best and count[start] + 1 < least):
                            best, least = value, count[start] + 1
                score.append(best)
                count.append(least)
            result.append(count[len(word)])
            previous = word
        return result

    def count_block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each row."""
        words = split_words(column)
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), dtype=bool)
        inner = at < len(self.known)
        seen[inner] = self.known[at[inner]] == distinct[inner]
        counts = np.zeros(len(distinct), np.int64)
        counts[seen] = self.counts[at[seen]]
        new = np.flatnonzero(~seen)
        texts = [_MARK + words.data[a:b].tobytes().decode("utf-8") for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        counts[new[order]] = self.terminal_counts(texts[i] for i in order)
        if len(self.known) + len(new) > MEMORY_ENTRIES:
            self.known, self.counts = distinct, counts
        else:
            self.known, self.counts = np.insert(self.known, at[new], distinct[new]), np.insert(self.counts, at[new], counts[new])
        total = np.concatenate([[0], np.cumsum(counts[inverse])])
        return words.counts, total[words.first[1:]] - total[words.first[:-1]]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: ``doc_id, n_pre_tokens, n_tokens``.

    Pre-tokens are runs without ASCII white space, each with a leading word mark. A null or empty text has none;
    repeated rows count alike; texts of any length are counted whole, and of equally good segmentations
    the one of fewest pieces counts; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()

    def count(block: pa.RecordBatch) -> pa.RecordBatch:
        words, tokens = Unigram.get(path).count_block(block.column(1))
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(chosen, count, "doc_id long, n_pre_tokens long, n_tokens long")
