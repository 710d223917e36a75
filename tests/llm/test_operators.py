"""Operators against brute force over small odd tables."""

import collections
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evq.llm import decontaminate, near_duplicates, packing, quality, repeats
from evq.llm.token_counts import token_counts
from evq.llm.token_files import decode_file, read_token_files, token_table, write_token_files
from evq.llm.tokens import BatchEncoder, tokenizer_path
from llm import corpus
from llm.corpus import split

PAIRS = corpus.rows()


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, PAIRS).persist()


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


# --- 7: repeated passages


def repeated(pairs):
    first = {}
    for d, t in pairs:
        w = split(t)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, float("inf")), order(d))
    for d, t in pairs:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(d):
                gone[i : i + 50] = [True] * 50
        yield d, w, gone


def test_kept_words(docs):
    want = [(d, len(w), sum(g), hashlib.sha256(" ".join(x for x, r in zip(w, g) if not r).encode()).hexdigest()) for d, w, g in repeated(PAIRS)]
    got = [tuple(r) for r in repeats.kept_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in got) > 1000


def test_remove_repeats(docs):
    cleaned = repeats.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    want = sorted(" ".join(x for x, r in zip(w, g) if not r) for _, w, g in repeated(PAIRS))
    rows = cleaned.collect()
    assert sorted(" ".join(split(r["text"])) for r in rows) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert all(r["mark"] == (None if r["doc_id"] is None else f"mark{r['doc_id']}") for r in rows)


@pytest.mark.parametrize("ends", [False, True])
def test_repeats_of_random_pairs(spark, ends):
    """Passages of 50 to 89 words that two documents share: words that differ after it, or the smaller document ends with it."""
    rng = random.Random(int(ends))
    word = lambda pair: f"{pair}x{rng.getrandbits(40):x}"
    pairs, want = [], {}
    for pair in range(4000):
        passage = [word(pair) for _ in range(rng.randrange(50, 90))]
        for side in (0, 1):
            before = [word(pair) for _ in range(rng.randrange(40))]
            after = [] if ends and not side else [word(pair) for _ in range(rng.randrange(1, 40))]
            pairs.append((2 * pair + side, " ".join(before + passage + after)))
            want[2 * pair + side] = side * len(passage)
    got = {r[0]: r[1] for r in repeats.kept_words(corpus.frame(spark, pairs, clash=False)).select("doc_id", "n_removed").collect()}
    assert {d: (got[d], n) for d, n in want.items() if got[d] != n} == {}


@pytest.mark.parametrize("frequent", [1, 20, 10**9])
def test_repeats_of_frequent_values(spark, frequent, monkeypatch):
    """The result does not depend on which values are frequent: none, some or all."""
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(80)]
    pairs = [(i, " ".join(corpus.prose(rng, rng.randrange(30)).split() + common[: rng.choice((50, 70, 80))] + corpus.prose(rng, rng.randrange(60)).split())) for i in range(90)]
    pairs += [(100 + i, " ".join(rng.choice("ab") for _ in range(70))) for i in range(10)] + [(200 + i, pairs[i][1]) for i in range(30)] + [(None, pairs[0][1]), (300, None), (301, "")]
    got = sorted(((r[0], r[1]) for r in repeats.kept_words(corpus.frame(spark, pairs)).select("doc_id", "n_removed").collect()), key=str)
    assert got == sorted(((d, sum(gone)) for d, _, gone in repeated(pairs)), key=str)


# --- 3: benchmark passages

ITEMS = [
    (1, " ".join(split(PAIRS[0][1])[:14])), (2, "One"), (3, "one, TWO three"), (4, None), (5, ""), (None, " ".join(corpus.prose(random.Random(5), 150).split(" ")[60:75])),
    (7, "nowhere to be found in any of the documents at all, at all"), (7, "two three four"), (10, "one"),
]


def leaks(pairs, items):
    windows = {}
    for k, t in items:
        w = corpus.ALNUM.findall((t or "").translate(corpus.LOWER))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if k is None else str(k))
    for d, t in pairs:
        w = corpus.ALNUM.findall((t or "").translate(corpus.LOWER))
        hit, found = [False] * len(w), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        yield d, w, hit, found


@pytest.mark.parametrize("limit", [decontaminate.BENCHMARK_BYTES, 60])
def test_contamination(spark, docs, limit):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = [(d, len(w), sum(h), len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), any(h)) for d, w, h, f in leaks(PAIRS, ITEMS)]
    got = [tuple(r) for r in decontaminate.contamination(docs, benchmark, limit=limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[5] for r in got) > 3


def test_items_without_name_and_repeated_items(spark):
    """A null and an empty item id are two items, both named by the empty string; repeated rows are one item."""
    items = spark.createDataFrame([(None, "alpha beta"), ("", "gamma"), ("b", "delta"), ("b", "alpha"), *[("a", "delta")] * 50], "item_id string, text string")
    assert sum(len(p.windows) for p in decontaminate.benchmark_blocks(items)) == 4
    some = corpus.frame(spark, [(1, "Alpha beta gamma"), (2, "delta"), (3, "beta"), (4, None)], False)
    for limit in (decontaminate.BENCHMARK_BYTES, 8):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(some, items, limit=limit).collect()}
        names = {1: (3, 3, ",,b"), 2: (1, 2, "a,b"), 3: (0, 0, ""), 4: (0, 0, "")}
        assert got == {d: (hit, n, hashlib.sha256(text.encode()).hexdigest()) for d, (hit, n, text) in names.items()}


def test_remove_leaks(spark, docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    cleaned = decontaminate.remove_leaks(docs, benchmark)
    assert cleaned.columns == docs.columns
    want = sorted([x for x, g in zip(w, h) if not g] for _, w, h, _ in leaks(PAIRS, ITEMS))
    assert sorted(corpus.ALNUM.findall((r["text"] or "").translate(corpus.LOWER)) for r in cleaned.collect()) == want


def test_long_document_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 64)
    wanted = decontaminate.phrases(ITEMS)
    column = pa.array([t for _, t in PAIRS])
    words, hit, doc, item = decontaminate.search(column, wanted)
    for i, (_, w, h, f) in enumerate(leaks(PAIRS, ITEMS)):
        assert hit[words.first[i] : words.first[i + 1]].tolist() == h
        assert {wanted.items[k] or "" for k in item[doc == i]} == f  # no name: null until it is joined


# --- 5: quality


def test_rule_counts(docs):
    want = []
    for d, t in PAIRS:
        t = t or ""
        w, seen, dup = split(t), set(), 0
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = [False] * len(w)
        for i in range(len(w) - 2):
            if three[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [True] * 3
        failed = len(w) < 50 or 100 * sum(hit) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), dup, sum(hit), failed))
    model = quality.Model(np.zeros(quality.LEAST_BUCKETS), 0.0)
    judged = quality.judge(docs, model, ["doc_id"])
    got = [tuple(r) for r in judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert judged.where("kept = base_failed").count() == 0


def junk(spark):
    rng = random.Random(9)
    good = [(i, corpus.prose(rng, 80, 5)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}$$$" for w in corpus.prose(rng, 80, 5).split(" "))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    return good + bad, labels


def test_quality_separates_junk(spark):
    pairs, labels = junk(spark)
    docs = corpus.frame(spark, pairs)
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert all(rows[d]["kept"] == (d < 100) for d, _ in pairs)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(60))


def quality_by_hand(spark, pairs, labels):
    """Score and verdict of each text: exact n-grams, plain loops; only the bucket of an n-gram is asked for."""
    from evq.llm.words import split_words

    known = {}
    for d, q in labels:
        if d is not None and q in (0, 1):
            known[d] = min(q, known.get(d, 1))
    ids = spark.createDataFrame([(d,) for d in known], "doc_id long")
    probe = {r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(quality.PROBE_SHARE)) == 0).collect()}
    size = quality.number_of_buckets(sum(len((t or "").encode()) for _, t in pairs))
    bucket_of = {}

    def ngrams(text):
        words = corpus.split(text)
        found = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
        for gram in set(found) - set(bucket_of):
            bucket_of[gram] = int(quality.buckets(split_words(pa.array([gram])), size)[0][-1])
        return [bucket_of[gram] for gram in found]

    raw, trusted = collections.Counter(), collections.Counter()
    for d, t in pairs:
        raw.update(ngrams(t))
        if known.get(d) == 1 and d not in probe:
            trusted.update(ngrams(t))
    total_raw, total = sum(raw.values()) + size, sum(trusted.values()) + size
    weight = {b: math.log((trusted[b] + 1) / total) - math.log((raw[b] + 1) / total_raw) for b in raw}
    score, failed = [], []
    for _, t in pairs:
        words, grams = corpus.split(t), ngrams(t)
        score.append(sum(weight[b] for b in grams) / max(1, len(grams)))
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        failed.append(len(words) < 50 or 100 * len(hit) > 50 * len(words))
    judged = {}
    for (d, _), v, f in zip(pairs, score, failed, strict=True):
        if not f and (known.get(d) == 0 or d in probe):
            judged[d] = min(v, judged.get(d, v))
    # The cut with the fewest errors, each class weighed by its size; midway between the scores beside it.
    values = sorted((v, known[d] == 1) for d, v in judged.items())
    good = sum(g for _, g in values)
    errors = [sum(g for _, g in values[:i]) / good + sum(not g for _, g in values[i:]) / (len(values) - good) for i in range(len(values) + 1)]
    cut = min(range(len(errors)), key=lambda i: (round(errors[i], 12), i))
    limit = values[0][0] - 1e-9 if cut == 0 else (values[cut - 1][0] + values[min(cut, len(values) - 1)][0]) / 2
    return [(v, not f and v >= limit) for v, f in zip(score, failed, strict=True)], limit


def test_quality_equals_brute_force(spark):
    rng = random.Random(19)
    pairs = [(i, corpus.prose(rng, rng.choice([40, 60, 90]), 5)) for i in range(80)]
    # junk of all degrees: some words are marked
    pairs += [(100 + i, " ".join(f"{w}$$$" if rng.random() < i / 40 else w for w in corpus.prose(rng, 80, 5).split(" "))) for i in range(40)]
    pairs += [(200, None), (201, ""), (None, pairs[0][1]), pairs[1], pairs[1], (202, "again and again " * 200), (203, corpus.prose(rng, 50_000, 5)), (5, "a second text of a good id " + corpus.prose(rng, 60, 5))]
    labels = [(i, 1) for i in range(0, 80, 2)] + [(100 + i, 0) for i in range(0, 40, 2)] + [(4, 0), (102, 1), (None, 1), (6, None), (6, 7)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = corpus.frame(spark, pairs)
    want, limit = quality_by_hand(spark, pairs, labels)
    assert quality.fit(docs, frame).threshold == pytest.approx(limit, abs=1e-6)
    got = sorted(((str(r["doc_id"]), round(r["score"], 5), r["kept"]) for r in quality.quality(docs, frame).collect()))
    assert got == sorted((str(d), round(v, 5), kept) for (d, _), (v, kept) in zip(pairs, want, strict=True))
    assert 10 < sum(kept for _, kept in want) < len(pairs) - 10
    assert sorted(str(r["doc_id"]) for r in quality.keep_good(docs, frame).collect()) == sorted(str(d) for (d, _), (_, kept) in zip(pairs, want, strict=True) if kept)


def test_buckets_grow_with_the_corpus():
    sizes = [quality.number_of_buckets(n) for n in (0, 10**8, 10**10, 10**12)]
    assert sizes == [1 << 16, 1 << 16, 1 << 19, 1 << 22]


def test_threshold_reads_every_labelled_document(spark):
    # 50,000 labelled documents, whose scores overlap: the cut lies between two neighbours of all scores
    word = "concat('w', pmod(xxhash64(id, x), 40 + CAST(id % 7 AS INT) * IF(id % 5 = 0, 40, 10)))"
    docs = spark.range(50_000).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 52), x -> {word}), ' ') AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 5 = 0, 1, 0) AS quality")
    model = quality.fit(docs, labels)
    held = quality._verdicts(labels).where("quality = 0 OR probe").drop("probe")
    rows = quality.judge(docs, model, ["doc_id"]).where("NOT base_failed").join(held, "doc_id").select("score", "quality").toPandas()
    assert len(rows) > 40_000
    assert model.threshold == pytest.approx(quality.threshold(rows["score"].to_numpy(), rows["quality"].to_numpy() == 1), abs=1e-12)


def threshold_by_hand(pairs):
    pairs = sorted(pairs)
    good = sum(g for _, g in pairs)
    errors = [sum(g for _, g in pairs[:i]) * (len(pairs) - good) + sum(not g for _, g in pairs[i:]) * good for i in range(len(pairs) + 1)]
    cut = errors.index(min(errors))
    return pairs[0][0] - 1e-9 if cut == 0 else (pairs[cut - 1][0] + pairs[min(cut, len(pairs) - 1)][0]) / 2


def test_threshold_of_a_table(spark):
    rng = random.Random(23)
    tables = [[(float(rng.randrange(40)), rng.random() < 0.6) for _ in range(90)], [(rng.gauss(2.0 * g, 1.0), g) for g in [True, False, True] * 1500]]
    tables += [[(1.0, True), (2.0, False)], [(1.0, False), (1.0, True)], [(1.0, False), (2.0, True)], [(3.0, True), (3.0, True), (3.0, False), (4.0, False)]]
    for pairs in tables:
        got = quality.threshold_of(spark.createDataFrame(pairs, "score double, good boolean"))
        score, good = (np.array(v) for v in zip(*pairs))
        assert got == pytest.approx(threshold_by_hand(pairs), abs=1e-12) and quality.threshold(score, good) == got
    for alone in ([], [(1.0, True)]):
        assert quality.threshold_of(spark.createDataFrame(alone, "score double, good boolean")) == quality.DEFAULT_THRESHOLD


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.0}
    assert quality.threshold(np.array([1.0, 2.0, 3.0, 4.0]), np.array([False, False, True, True])) == 2.5
    assert quality.threshold(np.array([1.0, 2.0]), np.array([True, True])) == quality.DEFAULT_THRESHOLD


# --- 1: near duplicates


def near(pairs, least_share=(4, 5)):
    sets = {}
    for d, t in pairs:
        w = split(t)
        if w:
            sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), []).append(d)
    keys = list(sets)
    link = [[j for j in range(len(keys)) if j != i and least_share[1] * len(keys[i] & keys[j]) >= least_share[0] * len(keys[i] | keys[j])] for i in range(len(keys))]
    root = list(range(len(keys)))
    for _ in keys:
        for i, others in enumerate(link):
            for j in others:
                root[i] = root[j] = min(root[i], root[j])
    for d, t in pairs:
        w = split(t)
        if not w:
            yield d, d, 0, 1
            continue
        i = keys.index(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
        least = min(order(x) for k in range(len(keys)) if root[k] == root[i] for x in sets[keys[k]])
        yield d, None if least == float("inf") else least, len(link[i]), len(sets[keys[i]])


def test_near_duplicates(docs):
    got = [tuple(r) for r in near_duplicates.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies").collect()]
    want = list(near(PAIRS))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] for r in got) >= 12


def test_lower_similarity(spark):
    """Pairs between 0.5 and 0.8 alone are found when 0.5 is asked for, and not otherwise."""
    rng = random.Random(12)
    pairs = []
    for i in range(60):
        words = corpus.prose(rng, 110, 5000).split(" ")
        pairs.append((2 * i, " ".join(words)))
        for at in range(10, 10 + 12 * (2 + i % 4), 12):
            words[at] = f"new{i}"
        pairs.append((2 * i + 1, " ".join(words)))
    docs = corpus.frame(spark, pairs)
    for similarity, share in ((0.5, (1, 2)), (0.8, (4, 5))):
        got = near_duplicates.near_duplicates(docs, similarity).select("doc_id", "class_id", "n_links", "n_copies").collect()
        want = sorted(near(pairs, share))
        assert sorted(map(tuple, got)) == want
        assert (sum(r[2] for r in want) >= 80) == (similarity == 0.5)


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    base = split(corpus.prose(random.Random(8), 200))
    pairs = []
    for i in range(40):
        w = list(base)
        w[3 * i + 10] = f"new{i}"
        pairs.append((i, " ".join(w)))
    pairs += [(100 + i, corpus.prose(random.Random(i), 100)) for i in range(30)]
    monkeypatch.setattr(near_duplicates, "BUCKET", 8)
    got = [tuple(r) for r in near_duplicates.near_duplicates(corpus.frame(spark, pairs, False)).select("doc_id", "class_id", "n_links", "n_copies").collect()]
    assert sorted(got) == sorted(near(pairs)) and sum(r[2] for r in got) == 40 * 39


def test_runs_reach_the_recall():
    assert near_duplicates.runs_for(0.5, 1.0) == 1
    runs = near_duplicates.runs_for()
    assert 2 <= runs <= 8 and near_duplicates.runs_for(0.999999) > runs


def test_texts_are_joined_alike_at_every_size(spark):
    # a broadcast of a small corpus's sets gives way to a shuffle of a larger one's: its disk could not be foretold
    pairs = [(i, corpus.prose(random.Random(i % 20), 60, 5)) for i in range(40)]
    plan = near_duplicates.one_of_each(corpus.frame(spark, pairs))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_one_of_each(spark):
    pairs = PAIRS[:-1]  # without the id that has two texts, in two classes
    docs = corpus.frame(spark, pairs)
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    with_words = [(d, t) for d, t in pairs if split(t)]
    classes = {}
    for (d, t), (_, c, _, _) in zip(with_words, near(with_words)):
        classes.setdefault((c, None if c is not None else frozenset(split(t))), d)
    rows = kept.collect()
    assert len([r for r in rows if split(r["text"])]) == len(classes)
    assert Counter(r["doc_id"] for r in rows if split(r["text"])) == Counter(c for c, _ in classes)
    assert len([r for r in rows if not split(r["text"])]) == len([t for _, t in pairs if not split(t)])


# --- 6 and 8: token files and packing


def ids_of(text, end):
    library = BatchEncoder.get(tokenizer_path()).library
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    manifest = write_token_files(docs, f"file://{folder}/out", file_bytes=3000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = read_token_files(manifest, f"file://{folder}/out").orderBy("start").collect()
    assert len(rows) == len(PAIRS) and manifest.count() > 3
    assert [order(r["doc_id"]) if r["doc_id"] is not None else -1 for r in rows] == sorted(-1 if d is None else d for d, _ in PAIRS)
    want = Counter((d, len(ids_of(t, 0)), zlib.crc32(ids_of(t, 0))) for d, t in PAIRS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()
    name = manifest.orderBy("file").first()["file"]
    with open(f"{folder}/out/{name}", "rb") as f:
        file = decode_file(f.read())
    assert file.nulls == 2 and file.document(0).tolist() in [ids_of(t, 0).tolist() for d, t in PAIRS if d is None]


def test_packing(docs):
    rows = packing.pack_documents(docs, group_documents=20).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    want = Counter()
    for d, t in PAIRS:
        ids = ids_of(t, 1)
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[d, start, len(part), zlib.crc32(part), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) < sum(r["length"] for r in rows) / 2048 + 6


# --- very long texts


def test_very_long_texts(spark):
    """Texts of 4 MB, more than a block, a shard or a piece holds, beside columns with the operators' own names."""
    rng = random.Random(31)
    words = corpus.prose(rng, 600_000, 100_000).split(" ")
    pairs = [(1, " ".join(words)), (2, " ".join(words[:-100] + ["other"] * 20)), (3, "a short one"), (4, None)]
    docs, n = corpus.frame(spark, pairs).persist(), {d: len(split(t)) for d, t in pairs}
    assert len(pairs[0][1]) > decontaminate.SHARD_BYTES and n[1] == 600_000 > decontaminate._PIECE
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert classes == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.kept_words(docs).collect()}
    assert kept == {1: (n[1], 0), 2: (n[2], n[2] - 20), 3: (3, 0), 4: (0, 0)}
    item = spark.createDataFrame([(1, " ".join(words[-12:]))], "item_id long, text string")
    alnum = {d: len(corpus.ALNUM.findall(t or "")) for d, t in pairs}
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, item).collect()}
    assert hits == {d: (alnum[d], len(corpus.ALNUM.findall(" ".join(words[-12:]))) if d == 1 else 0) for d in alnum}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality.quality(docs, labels).collect()}
    assert judged == {d: (n[d], sum(map(len, split(t)))) for d, t in pairs}
    ids = {d: ids_of(t, 0) for d, t in pairs}
    files = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_table(docs).collect()}
    assert files == {d: (len(x), zlib.crc32(x)) for d, x in ids.items()}
    lengths = Counter()
    for r in packing.pack_documents(docs).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {d: len(x) for d, x in ids.items()}
    pre = {r["doc_id"]: r["n_pre_tokens"] for r in token_counts(docs).collect()}
    assert pre == n


# --- empty tables


def test_empty_tables(spark):
    docs = corpus.empty(spark)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        repeats.kept_words(docs), repeats.remove_repeats(docs), decontaminate.contamination(docs, benchmark), decontaminate.remove_leaks(docs, benchmark),
        quality.quality(docs, labels), quality.keep_good(docs, labels), near_duplicates.near_duplicates(docs), near_duplicates.one_of_each(docs),
        token_table(docs), packing.pack_documents(docs),
    ):
        assert result.count() == 0
    some = corpus.frame(spark, [(1, "a b c"), (2, None)], False)
    assert [r["n_hit"] for r in decontaminate.contamination(some, benchmark).collect()] == [0, 0]
    assert sorted(r["text"] or "" for r in decontaminate.remove_leaks(some, benchmark).collect()) == ["", "a b c"]
