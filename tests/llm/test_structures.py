import random

import numpy as np
import pytest

from evq.llm.elias_fano import EliasFano
from evq.llm.fm_index import FMIndex, WaveletTree, suffix_array
from evq.llm.packing import SEQUENCE, Tournament, first_fit_decreasing
from evq.llm.token_files import decode_file, encode_file


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], [-9, -9, 4, 1 << 40], [-(1 << 63), 0, (1 << 63) - 1], list(range(0, 50_000, 7))])
def test_elias_fano(values):
    coded = EliasFano.encode(np.array(values, np.int64))
    data = coded.to_bytes()
    back, size = EliasFano.from_bytes(memoryview(data + b"more"))
    assert size == len(data) and back.values().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 50)):
        assert back.select(i) == values[i]
    with pytest.raises(IndexError):
        back.select(len(values))
    if len(values) > 1000:
        assert len(data) < 2 * len(values)


def test_elias_fano_needs_order():
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


@pytest.mark.parametrize("width", [2, 4])
def test_token_file_round_trip(width):
    rng = random.Random(2)
    documents = [[rng.randrange(50_000) for _ in range(rng.choice([0, 3, 700]))] + [0] for _ in range(40)]
    names = [None, None, *range(10, 48)]
    ends = np.cumsum([len(d) for d in documents])
    file = decode_file(encode_file(names, ends, np.concatenate([np.array(d) for d in documents]), width))
    assert file.nulls == 2 and file.doc_ids.values().tolist() == names[2:]
    for i, document in enumerate(documents):
        assert file.document(i).tolist() == document
    with pytest.raises(ValueError):
        decode_file(b"something else entirely, and long enough")


def sequences():
    rng = random.Random(7)
    copies = [rng.randrange(1, 5) for _ in range(40)]
    yield [0]
    yield [0, 0, 0]
    yield [1, 1, 1, 1, 1, 0]
    yield [*copies, 0, *copies, 0, *copies, 0]
    yield [rng.choice([0, 1, 1, 2, 3]) for _ in range(600)] + [0]
    yield [rng.randrange(1, 3000) for _ in range(300)] + [0]


@pytest.mark.parametrize("text", list(sequences()))
def test_fm_index_equals_scanning(text):
    text = np.array(text)
    symbols = int(text.max()) + 1

    def suffix(i):  # breaks differ by their place
        end = i + int(np.flatnonzero(text[i:] == 0)[0])
        return [(int(c), 0) for c in text[i:end]] + [(0, end)]

    order = suffix_array(text, max(1, (symbols - 1).bit_length()))
    assert order.tolist() == sorted(range(len(text)), key=suffix)
    index = FMIndex(text, symbols)
    rng = random.Random(1)
    patterns = [[1], [1, 1], [1, 2, 3], [symbols - 1] * 10, [2, 1]]
    for _ in range(60):
        at, n = rng.randrange(len(text)), rng.randrange(1, 11)
        if len(text[at : at + n]) and (text[at : at + n] > 0).all():
            patterns.append(text[at : at + n].tolist())
    patterns = [p for p in patterns if 0 < min(p) and max(p) < symbols]
    table = np.zeros((len(patterns), 10), np.int32)
    for i, p in enumerate(patterns):
        table[i, : len(p)] = p
    low, high = index.ranges(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_wavelet_tree_rank_and_access():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 37, 1000).astype(np.uint32)
    tree = WaveletTree(symbols, 6)
    at = np.arange(0, 1001, 13)
    for c in range(37):
        base = tree.descend(np.array([c]), np.array([0]))[0]
        got = tree.descend(np.full(len(at), c), at) - base
        assert got.tolist() == [int((symbols[:i] == c).sum()) for i in at]
    assert tree.access(np.arange(1000))[0].tolist() == symbols.tolist()


def test_fm_index_refuses_what_it_cannot_hold():
    with pytest.raises(ValueError):
        FMIndex(np.array([1, 2]), 3)
    with pytest.raises(ValueError):
        FMIndex(np.zeros(0, int), 1)


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = random.Random(4)
    for lengths in ([], [1], [2048, 2048, 1], [rng.randrange(1, 2049) for _ in range(500)], [7] * 1000):
        lengths = np.array(lengths, np.int64)
        bins, offsets = first_fit_decreasing(lengths)
        free, want = [], {}
        for piece in np.argsort(-lengths, kind="stable").tolist():
            spot = next((b for b, f in enumerate(free) if f >= lengths[piece]), len(free))
            if spot == len(free):
                free.append(SEQUENCE)
            want[piece] = spot, SEQUENCE - free[spot]
            free[spot] -= lengths[piece]
        assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(len(lengths))]


def test_tournament_takes_the_first_that_fits():
    tree = Tournament(3, 10)
    assert [tree.first_fit(s) for s in (6, 6, 4, 4, 10)] == [0, 1, 0, 1, 2]
