import random

import numpy as np
import pyarrow as pa
import pytest

from evq.llm import words as W
from evq.llm.tokens import BatchEncoder, tokenizer_path
from llm import corpus

TEXTS = ["", None, " a  b\tc\n", "x", "née ça va", "A-B_c 12é", "  ", "\x0b\x0cq"] + [t for _, t in corpus.rows(4, 20)]


@pytest.mark.parametrize("table, lower, pattern", [(W.SPACE_WORDS, False, corpus.WORDS), (W.ALNUM_WORDS, True, corpus.ALNUM)])
def test_words_equal_the_pattern(table, lower, pattern):
    found = W.split_words(pa.array(TEXTS, pa.string()), table, lower)
    by_text = {}
    for i, text in enumerate(TEXTS):
        want = pattern.findall((text or "").translate(corpus.LOWER) if lower else text or "")
        a, b = found.first[i], found.first[i + 1]
        assert [found.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b])] == want
        for word, value in zip(want, found.hashes[a:b].tolist()):
            assert by_text.setdefault(word, value) == value
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 10, 13, 26, 50])
def test_window_hashes_tell_windows_apart(width):
    rng = random.Random(width)
    column = pa.array([" ".join(rng.choice("ab") for _ in range(120)) for _ in range(6)])
    found = W.split_words(column)
    hashes, at = W.window_hashes(found.hashes, width), W.inside_document(found.first, width)
    assert len(at) == 6 * (121 - width)
    words = [found.data[s:e].tobytes() for s, e in zip(found.starts, found.ends)]
    seen = {}
    for i in at.tolist():
        assert seen.setdefault(tuple(words[i : i + width]), hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_blocks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * 50, "", None, "c" * 500, "d"] * 7)], ["text"])
    parts = list(W.text_blocks(batch, "text", 150))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 7
    assert list(W.text_blocks(batch.slice(0, 0), "text")) == []


def test_covered_and_cuts():
    assert W.covered(8, np.array([1, 2, 6]), np.array([2, 2, 2])).tolist() == [False, True, True, True, False, False, True, True]
    column = pa.array(["a b  c d", "x y"])
    found = W.split_words(column)
    gone = np.array([False, True, True, False, True, True])
    texts = W.without_words(found, W.text_buffer(column)[1], gone)
    assert texts == {0: b"a d", 1: b""}
    assert W.replaced(pa.array(["p", None, "q"]), {2: b"new"}).to_pylist() == ["p", None, "new"]


ODD = [
    "don't 'start we're it's'  \n\n x '' 's \t\n a", "'", "a'", "a'll'd'ssss 've  b  ", "12 ab12 あい x", "<|endoftext|> a", "  ", "\n\n\n",
    " \n", "\n a", "x  y z  w", "a  'r", "'r", "'re", "'l l", "\n's", "?'s", "5's's", "\U0001f600 smile", "   a", "á é", "\x00\x1f",
]


def test_token_ids_equal_the_library():
    encoder = BatchEncoder.get(tokenizer_path())
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab '\n\t1.é!s") for _ in range(rng.randrange(40))) for _ in range(400)]
    texts = TEXTS + ODD + noise
    for _ in range(2):  # the second time from memory
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, text
    ids, offsets = encoder.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]
