"""Extraction, licences, toxicity and token counts."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evq.llm import html_crf, licences, toxicity
from evq.llm.html_blocks import blocks
from evq.llm.labelled_pages import PAGES
from evq.llm.token_counts import Unigram, token_counts, vocabulary_path
from llm import corpus

# --- 2: main text


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="Home-page"><!-- <p>no</p> --><script>var a="</p>";</script>
    <ul><li>one<li>two <b>bold</b></ul><p>a&amp;b &lt;c&gt;<br>d\n\n e<p>second <a href=x>link</a></div></p>loose<div id=main-text>x</div></body>tail <p"""
    found = blocks(page)
    assert [b.text for b in found] == ["one", "two bold", "a&b <c> d e", "second link", "loose", "x", "tail"]
    assert found[0].tags == ("html", "body", "ul", "li") and found[1].tags == ("html", "body", "ul", "li")
    assert found[3].linked == 4 and found[5].names == {"home", "page", "main", "text"}
    assert blocks("") == [] and blocks("   ") == [] and [b.text for b in blocks("plain")] == ["plain"]
    assert [b.text for b in blocks("<p>cut <b")] == ["cut"] and [b.text for b in blocks("1 < 2 <p>3")] == ["1 < 2", "3"]


def test_blocks_of_valid_pages_without_end_tags():
    article = "<article><h1>A b</h1><p>c d.<p>e f.</article>"
    want = ["A b", "c d.", "e f."]
    for page in (
        f"<html><head><title>x</title><body>{article}",
        f"<html><head><title>x</title><meta charset=utf-8><link rel=a><style>p{{}}</style><noscript><link rel=b></noscript>{article}",
        f"<title>x{article}",
        f"<iframe src=a>{article}",
        f"<textarea name=t>typed{article}",
    ):
        assert [b.text for b in blocks(page)][-3:] == want and not any("head" in b.tags for b in blocks(page)), page
    assert [b.text for b in blocks("<head>loose text<p>x")] == ["loose text", "x"]
    for inside in ("<select><option>one<option>two", "<select><option>one</select>", "<svg><path d=1>", "<svg><title>t</title></svg>", "<iframe>", "<datalist><option>one"):
        assert [b.text for b in blocks(f"<article><p>c d.</p>{inside}<p>e f.</p></article>")] == ["c d.", "e f."], inside
    assert [b.text for b in blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>an object</object> and <noscript>no script</noscript>.</p>")] == ["so x=1 and an object and no script."]
    assert [b.text for b in blocks("<p>a</p><script>var b = '<p>c</p>'")] == ["a"]


def test_main_text_of_pages_without_names():
    model = html_crf.train(html_crf.training_pages([]))
    paragraphs = ["Der Zug nach Norden fährt ab Montag wieder jede Stunde, wie die Bahn am Freitag nach langen Gesprächen mitgeteilt hat.", "Wer schon eine Karte hat, kann sie weiter nutzen oder zurückgeben.", "Auch am Abend sollen mehr Züge fahren, wenn genug Leute da sind, die sie lenken."]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<html><head><title>x</title><body><div><a href=a>Start</a> <a href=b>Hilfe</a></div><div>{body}</div><div>© 2022 Bahnblatt</div>"
    assert html_crf.main_text(page, model) == "\n".join(paragraphs)
    long = f"<body><article><h1>Long</h1>{body * 4000}</article></body>"
    assert len(long) > 1_000_000 and html_crf.main_text(long, model).endswith(paragraphs[-1]) and html_crf.main_text(long, model).count("\n") == 12_000
    whole = f"<body><div>{body}</div></body>"
    for cut in range(len(whole) - 60, len(whole), 7):
        assert html_crf.main_text(whole[:cut], model).startswith("\n".join(paragraphs[:2]))


def test_sample_does_not_depend_on_order(spark):
    rows = [(i % 5, "u", f"<article><h1>Title {i}</h1><p>{'word ' * (i % 7 + 10)}end.</p></article><div>x {i}</div>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    models = [html_crf.fit(df.repartition(n, *by)) for n, by in ((1, ()), (7, ("html",)))]
    assert models[0].numbers == models[1].numbers and (models[0].emission == models[1].emission).all()
    got = html_crf.extract(df.withColumn("_names", F.lit(1)), models[0]).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((d, html_crf.main_text(h, models[0])) for d, _, h in rows)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        emission, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def value(path):
            return sum(emission[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))

        every = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        assert html_crf.viterbi(emission, move) == max(every, key=value)
    assert html_crf.viterbi(np.zeros((0, 2)), np.zeros((2, 2))) == []


def test_training_likelihood_gradient_learns_a_chain():
    # A block's label depends on its neighbour, not on its own feature: only transitions can tell.
    pages = [([["start"]] + [["same"]] * 4, [1, 1, 1, 1, 1]), ([["other"]] + [["same"]] * 4, [0, 0, 0, 0, 0])] * 5
    model = html_crf.train(pages)
    for page, labels in pages[:2]:
        assert html_crf.viterbi(html_crf.scores(model, page), model.transition) == labels


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def test_extraction_on_pages_kept_out(spark, pages):
    # Train on half of the pages; the others must come out as their articles.
    model = html_crf.fit(pages.where("page_id % 2 = 0"))
    rows = html_crf.extract(pages.where("page_id % 2 = 1"), model).collect()
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == 25
    for r in rows:
        want = [b.text for b in blocks(texts[r["page_id"]]) if "article" in b.tags]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
    # and so must the pages labelled by hand
    for page in PAGES:
        assert html_crf.main_text(page, model) == "\n".join(b.text for b in blocks(page) if b.label == "main")


def test_labelled_pages_one_kept_out():
    right = total = 0
    for i in range(len(PAGES)):
        rest = PAGES[:i] + PAGES[i + 1 :]
        model = html_crf.train([(html_crf.features(blocks(p)), [int(b.label == "main") for b in blocks(p)]) for p in rest])
        found = blocks(PAGES[i])
        got = html_crf.viterbi(html_crf.scores(model, html_crf.features(found)), model.transition)
        right += sum(y == (b.label == "main") for y, b in zip(got, found))
        total += len(found)
    assert right / total > 0.9


def test_extraction_of_odd_pages(spark, pages):
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "y"), (1, "u", "", "y"), (2, "v", "<nav><a>m</a></nav>", "z")], "page_id long, url string, html string, text string")
    rows = html_crf.extract(odd, html_crf.fit(pages)).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("", 0)] * 4
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.extract(empty).count() == 0


# --- 4: licences


def plain_words(text):
    return corpus.ALNUM.findall((text or "").translate(corpus.LOWER))


def weights_by_hand(texts):
    """Idf of a word: frequencies are counted by its place in the hash table."""
    size = licences.number_of_buckets(sum(len((t or "").encode()) for t in texts))
    place = {}

    def place_of(word):
        if word not in place:
            place[word] = int(licences.hashed_words(pa.array([word])).hashes[0] % np.uint64(size))
        return place[word]

    frequency = collections.Counter(p for t in texts for p in {place_of(w) for w in plain_words(t)})
    return lambda word: math.log((1 + len(texts)) / (1 + frequency[place_of(word)])) + 1


def best_by_hand(text, idf):
    """Every passage of every template's length, by plain counting: ``(cosine, licence, words)``."""
    words, best = plain_words(text), (0.0, None, 0)
    for name, template in licences.TEMPLATES:
        want = collections.Counter(plain_words(template))
        vector = {w: n * idf(w) for w, n in want.items()}
        norm, size = math.sqrt(sum(v * v for v in vector.values())), sum(want.values())
        for at in range(max(1, len(words) - size + 1) if words else 0):
            have = collections.Counter(words[at : at + size])
            if not have.keys() & want.keys():
                continue
            mine = {w: n * idf(w) for w, n in have.items()}
            c = round(sum(v * vector.get(w, 0) for w, v in mine.items()) / norm / math.sqrt(sum(v * v for v in mine.values())), 9)
            if c > best[0]:
                best = (c, name, len(words[at : at + size]))
    return best


def test_licences_equal_brute_force(spark):
    rng = random.Random(3)
    statements = [t for _, t in licences.TEMPLATES]
    files = []
    for i in range(40):
        lines = [corpus.prose(rng, 12) for _ in range(rng.choice([0, 1, 5]))]
        if i % 3 == 0:
            said = rng.choice(statements).split(" ")
            for _ in range(rng.choice([0, 0, 1, 4])):  # cut, changed and added words
                said[rng.randrange(len(said))] = rng.choice(["", "other", "two words", "license"])
            lines.insert(rng.randrange(len(lines) + 1), "\n * ".join(" ".join(said[j : j + 9]) for j in range(0, len(said), 9)))
        files.append((i, f"{rng.choice(['a', 'a/b', 'a/b/c', 'd', ''])}/f{i}.txt".lstrip("/"), "\n".join(lines)))
    files += [(50, "a/LICENSE", "Some words first, and then many more of them\n" + statements[0]), (51, None, statements[2]), (52, "x/y", None), (53, "a/b/z", "")]
    files += [(54, "a/b/COPYING", statements[0].upper()), (55, "a/b/COPYING.LESSER", statements[0]), (56, "q/long", "word " * 100_000 + statements[3]), files[0]]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("licence", F.lit("clash")).withColumn("_dir", F.lit(1))
    found = licences.scan(df)
    idf, own, speaks = weights_by_hand([t for _, _, t in files]), {}, {}
    for d, path, text in files:
        # the long file only repeats one word that no template has
        score, licence, length = best_by_hand((text or "").replace("word " * 99_000, ""), idf)
        if score < licences.SIMILARITY:
            score, licence = 0.0, None
        own[d] = (score, licence)
        if licence and path is not None and (length / len(plain_words(text)) >= licences.FILE_SHARE or path.endswith(("LICENSE", "COPYING", "COPYING.LESSER"))):
            folder = path.rpartition("/")[0]
            speaks[folder] = min(speaks.get(folder, (9.0,)), (-score, path, licence))
    for r in found.collect():
        score, licence = own[r["doc_id"]]
        assert r["own_score"] == pytest.approx(score, abs=1e-8) and r["own_licence"] == licence, r
        if licence:
            assert (r["licence"], r["licence_from"], r["inherited_path"]) == (licence, "own", None)
            continue
        folder, want = (r["path"] or "").rpartition("/")[0], None
        while r["path"] is not None and want is None:
            want = speaks.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert (r["licence"], r["inherited_path"]) == ((want[2], want[1]) if want else (None, None))
        assert r["licence_from"] == ("inherited" if want else None)
    assert found.where("licence_from = 'inherited'").count() > 3 and found.where("licence_from = 'own'").count() > 10
    assert licences.scan(df.limit(0)).count() == 0


HEADERS = {
    "GPL-3.0": """
        This file is part of Foo.

        Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.

        Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.

        You should have received a copy of the GNU General Public License along with Foo. If not, see
        <http://www.gnu.org/licenses/>.""",
    "Apache-2.0": """
        Copyright 2019 The Example Authors. All Rights Reserved.

        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at

            http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """
        Copyright (c) 2015 A. Person

        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "LGPL-2.1": """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.

        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.""",
    "BSD-3-Clause": "Copyright 2010 The Go Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only",
    "BSD-2-Clause": "(C) 2020 me. SPDX-License-Identifier: BSD-2-Clause",
}


def test_public_headers_wrapped_in_comments(spark):
    import textwrap

    rng, files, want = random.Random(5), [], {}
    code = ["int main(void) { return 0; }", "def run(self): pass", "the license of a file is a matter of its own and of no other", "you can use any version of the software that you like"]
    for licence, text in HEADERS.items():
        for mark in ("# ", " * ", "// ", "-- "):
            lines = [mark + line for part in textwrap.dedent(text).split("\n\n") for line in textwrap.wrap(part, 80 - len(mark)) + [""]]
            path = f"{licence}/{len(files)}/file.src"
            files.append((path, "\n".join([*lines, *(rng.choice(code) + " " + corpus.prose(rng, 8) for _ in range(40))])))
            want[path] = licence
    for i in range(300):
        files.append((f"none/{i}/file.src", "\n".join(rng.choice(code) + " " + corpus.prose(rng, 8) for _ in range(40))))
    got = {r["path"]: r["licence"] for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {path: want.get(path) for path, _ in files}


# --- 9: toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    size, terms = 700, 60
    dense = np.where(rng.random((size, terms)) < 0.08, rng.random((size, terms)), 0)
    dense[:5] = 0
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    row, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(toxicity.Vectors(term, dense[row, term], np.searchsorted(row, np.arange(size + 1))), terms)
    for i in range(0, 200, 3):
        mine = np.flatnonzero(dense[i])
        if not len(mine):
            continue
        for without in (-1, i):
            cosine = dense @ dense[i]
            if without >= 0:
                cosine[without] = 0
            got, values = index.nearest(mine, dense[i][mine], 10, without)
            best = np.sort(cosine)[::-1][:10]
            best = best[best > 1e-12]
            assert values == pytest.approx(np.minimum(best, 1.0)) and cosine[got] == pytest.approx(values)


def test_blocks_are_skipped():
    # Blocks of examples with their own strong words: a query with one of them reads little else.
    rng = np.random.default_rng(4)
    size, terms = 50 * toxicity.BLOCK, 150
    dense = np.where(rng.random((size, terms)) < 0.3, 0.1, 0)
    dense[:, :50] = np.repeat(np.eye(50), toxicity.BLOCK, axis=0) * rng.uniform(3, 4, (size, 1))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(toxicity.Vectors(term, dense[row, term], np.searchsorted(row, np.arange(size + 1))), terms)
    for i in range(0, size, 97):
        mine = np.flatnonzero(dense[i])
        index.postings_read = 0
        got, values = index.nearest(mine, dense[i][mine], 25)
        assert values == pytest.approx(np.minimum(np.sort(dense @ dense[i])[::-1][:25], 1.0))
        assert index.postings_read < 0.15 * np.isin(term, mine).sum()


def test_light_words_are_read_for_few_examples():
    # Ten telling words weigh most in nine of ten vectors; the others, and some queries, have light words alone.
    rng = np.random.default_rng(9)
    size, terms, k = 12 * toxicity.BLOCK + 7, 400, 25
    dense = np.where(rng.random((size, terms)) < 0.2, rng.random((size, terms)) * 0.05, 0)
    light = np.arange(terms) >= 60
    dense[:, ~light] = np.where(rng.random((size, 60)) < 0.1, rng.random((size, 60)), 0) * (rng.random((size, 1)) < 0.9)
    dense[900:960] = dense[7]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    vectors = toxicity.Vectors(term, dense[row, term], np.searchsorted(row, np.arange(size + 1)))
    index = toxicity.BlockMaxIndex(vectors, terms, light)
    model = toxicity.Model(np.arange(terms), np.ones(terms), index, rng.integers(0, 2, size).astype(float), np.arange(size), 0.5, 0.5, np.zeros(0), np.zeros(0))
    rows = np.arange(0, size, 41)
    for themselves in (False, True):
        for i, (value, near) in zip(rows, toxicity.votes_of(model, vectors, rows, themselves), strict=True):
            cosine = dense @ dense[i]
            if themselves:
                cosine[i] = 0
            want = np.lexsort((np.arange(size), -np.round(cosine, 12)))[:k]
            pull = cosine[want] ** 2
            assert near.tolist() == want.tolist()
            assert value == pytest.approx((pull @ model.labels[want] + toxicity.PRIOR / 2) / (pull.sum() + toxicity.PRIOR))
    lists = [np.isin(term, np.flatnonzero(dense[i])).sum() for i in rows]
    heavy = [i for i in range(len(rows)) if dense[rows[i], ~light].any()]
    index.postings_read = 0
    assert len(list(toxicity.votes_of(model, vectors, rows[heavy]))) == len(heavy) > 50
    assert index.postings_read < 0.4 * sum(lists[i] for i in heavy)


def test_isotonic():
    votes, odds = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert odds.tolist() == [0.0, 0.5, 1.0] and votes.tolist() == [0.1, 0.25, 0.4]


def insults(spark):
    rng = random.Random(6)
    pairs, labels = [], []
    for i in range(600):
        words = corpus.prose(rng, rng.choice([30, 200]), 150).split(" ")
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Scum!", "clown", "vile,"])
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return pairs, labels, spark.createDataFrame(labels + [(None, 1), (3, labels[3][1])], "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    pairs, truth, labels = insults(spark)
    pairs = pairs + [(None, "vile clown"), (900, None), (901, ""), pairs[5]]
    docs = corpus.frame(spark, pairs)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(pairs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = dict(truth)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    blank = {r["score"] for r in rows if r["doc_id"] in (900, 901)}
    assert len(blank) == 1 and blank.pop() < 0.2
    assert next(r for r in rows if r["doc_id"] is None)["predicted"] == 1
    evidence = {e for r in rows for e in r["evidence"]}
    assert evidence and not any(toxicity.held_out(e) for e in evidence)


def scored_by_hand(pairs, truth):
    """The vote of every text: plain all-pairs cosine over all words of the examples."""
    words = lambda text: corpus.ALNUM.findall((text or "").translate(corpus.LOWER))
    texts = {}
    for d, text in pairs:
        if d in truth and zlib.crc32(str(d).encode()) % 5:
            texts[d] = min((t for t in (texts.get(d), text) if t is not None), default=None)
    examples = {d: set(words(t)) for d, t in texts.items()}
    n1 = sum(truth[d] for d in examples)
    n0, vocabulary = len(examples) - n1, set().union(*examples.values())
    scale = {}
    for w in vocabulary:
        a, b = (sum(w in found and truth[d] == y for d, found in examples.items()) for y in (1, 0))
        chi = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / max(n0 * n1 * (a + b) * (n0 + n1 - a - b), 1e-9)
        frequency = sum(w in set(words(t)) for _, t in pairs)
        scale[w] = (math.log((1 + len(pairs)) / (1 + frequency)) + 1) * (toxicity.BASE + max(chi - toxicity.CHANCE, 0))

    def vector(text):
        found = words(text)
        weights = {w: (1 + math.log(found.count(w))) * scale[w] for w in set(found) if w in scale}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        return {w: v / norm for w, v in weights.items()}

    vectors = {d: vector(t) for d, t in texts.items()}
    share = n1 / (n0 + n1)

    def vote(text):
        mine = vector(text)
        near = sorted(((sum(v * other.get(w, 0) for w, v in mine.items()), d) for d, other in vectors.items()), reverse=True)
        near = [(c, d) for c, d in near[: toxicity.NEIGHBOURS] if c > 1e-12]
        pull = sum(c * c for c, _ in near)
        return (sum(c * c * truth[d] for c, d in near) + toxicity.PRIOR * share) / (pull + toxicity.PRIOR) if near else None

    return [vote(t) for _, t in pairs]


def test_scores_equal_a_plain_all_pairs_vote(spark):
    rng = random.Random(12)
    pairs = [(i, corpus.prose(rng, rng.choice([20, 60]), 30) + (f" insult{i % 7} insult{i % 7}" if i % 4 == 0 else "")) for i in range(160)]
    truth = {i: int(i % 4 == 0) for i in range(140)}
    pairs += [(3, "another text of three"), (900, "zzz unknown words only"), (901, None), (902, "insult3"), (903, "word " * 200_000 + "insult5")]
    docs, labels = corpus.frame(spark, pairs), spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    votes = scored_by_hand(pairs, truth)
    want = [model.blank_share if v is None else float(toxicity.calibrated(model, np.array([v]))[0]) for v in votes]
    got = [(r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, labels).collect()]
    assert sorted(got) == sorted((d, round(v, 9)) for (d, _), v in zip(pairs, want, strict=True))


def test_rare_insults_and_repeated_ids(spark):
    """Twenty insults of ten documents each; one example's id is carried by thousands of rows."""
    rng, pairs = random.Random(1), []
    for i in range(400):
        words = corpus.prose(rng, rng.choice([30, 100, 200])).split(" ")
        for _ in range(3 * (i % 2)):
            words[rng.randrange(len(words))] = f"insult{i // 2 % 20}"
        pairs.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    docs = corpus.frame(spark, pairs + [pairs[7]] * 3000, False)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert len(held) > 60 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) > 0.85 * len(held)
    assert len({r["score"] for r in held}) > 10
    assert len(toxicity.fit(docs, labels).ids) == sum(not toxicity.held_out(i) for i in range(400))


def test_held_out_labels_are_never_read(spark):
    pairs, truth, labels = insults(spark)
    docs = corpus.frame(spark, pairs, False)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    both = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, t).collect()} for t in (labels, turned)]
    assert both[0] == both[1]


def test_toxicity_without_examples(spark):
    docs = corpus.frame(spark, [(1, "a b"), (2, None)], False)
    labels = "doc_id long, toxic int"
    assert [r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame([], labels)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(i, 1) for i in range(5)], labels)
    assert {r["score"] for r in toxicity.toxicity(docs, one).collect()} == {1.0}
    assert toxicity.toxicity(corpus.empty(spark), one).count() == 0


# --- 10: token counts


def segmentations(word, pieces, unknown):
    """Best score and, of the best, the fewest pieces, over all segmentations."""
    if not word:
        return 0.0, 0
    best = None
    for n in range(1, len(word) + 1):
        cost = [pieces[word[:n]]] if word[:n] in pieces else []
        count = [1] * len(cost)
        if n == 1:
            width = len(word[0].encode())
            cost.append(unknown * width)
            count.append(width)
        rest = segmentations(word[n:], pieces, unknown) if cost else None
        for c, k in zip(cost, count):
            found = (c + rest[0], -(k + rest[1]))
            best = found if best is None or found > best else best
    return best[0], -best[1]


def test_trie_counts_equal_all_segmentations():
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 12)) for _ in range(40)}
    model = Unigram(pieces)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(0, 11))) for _ in range(300)})
    assert model.terminal_counts(words) == [segmentations(w, pieces, model.unknown)[1] for w in words]


def test_token_counts(spark):
    pairs = corpus.rows(2, 30)
    rows = token_counts(corpus.frame(spark, pairs)).collect()
    model = Unigram.from_file(vocabulary_path())
    want = sorted((str(d), len(corpus.split(t)), sum(model.terminal_counts(["▁" + w])[0] for w in corpus.split(t))) for d, t in pairs)
    assert sorted((str(r["doc_id"]), r["n_pre_tokens"], r["n_tokens"]) for r in rows) == want
    assert token_counts(corpus.empty(spark)).count() == 0


def test_remembered_words_count_alike(monkeypatch):
    monkeypatch.setattr("evq.llm.token_counts.MEMORY_ENTRIES", 50)
    model = Unigram.from_file(vocabulary_path())
    column = pa.array([t for _, t in corpus.rows(3, 20)])
    first = model.count_block(column)[1].tolist()
    assert model.count_block(column)[1].tolist() == first
