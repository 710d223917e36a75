"""Main-text extraction with a linear-chain conditional random field over leaf blocks.

Each block has binary features of its ancestor tags, the names around it and its
text; a first-order chain with two labels (article, rest) is trained by gradient
ascent on the regularised conditional likelihood and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.html_blocks import Block, blocks
from evq.llm.labelled_pages import PAGES

#: Pages of the table used for training at most, and the longest of them in bytes.
SAMPLE_PAGES = 200
SAMPLE_BYTES = 200_000
ROUNDS = 150
RATE = 0.15
PENALTY = 0.02
#: Parts of class names and ids that tell what an element is for.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related recommended reply replies respond "
    "search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe tags teaser toc toolbar topbar widget".split()
)
ARTICLE_NAMES = frozenset("article body content entry main post story text".split())
_STEPS = (1, 3, 6, 11, 21, 41)


def features(page: list[Block], without: frozenset[str] = frozenset()) -> list[list[str]]:
    """Names of the features that hold for each block. ``without`` hides tags and names, to train on less obvious pages."""
    result = []
    for place, block in enumerate(page):
        words = block.text.split()
        size = sum(len(words) >= s for s in _STEPS)
        share = block.linked / max(1, len(block.text))
        link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3
        tags = [t for t in block.tags if t not in without]
        names = block.names - without
        own = next((t for t in reversed(tags)), "")
        part = 0 if place == 0 else 2 if place == len(page) - 1 else 1
        found = {"any", f"own={own}", f"size={size}", f"link={link}", f"size={size},link={link}", f"own={own},size={size}", f"part={part}"}
        found.update(f"in={t}" for t in tags)
        found.update(f"name={n}" for n in names)
        if names & BOILERPLATE_NAMES:
            found.add("boilerplate-name")
        if names & ARTICLE_NAMES and not names & BOILERPLATE_NAMES:
            found.add("article-name")
        if block.text[-1] in ".!?:;\"'”»…":
            found.add("sentence-end")
        if "©" in block.text or "copyright" in block.text.lower() or "all rights reserved" in block.text.lower():
            found.add("copyright")
        if sum(c.isdigit() for c in block.text) * 3 > len(block.text):
            found.add("digits")
        result.append(sorted(found))
    return result


class Model(NamedTuple):
    numbers: dict[str, int]
    emission: np.ndarray  # (features, 2)
    transition: np.ndarray  # (2, 2)


def scores(model: Model, page: list[list[str]]) -> np.ndarray:
    result = np.zeros((len(page), 2))
    for i, names in enumerate(page):
        known = [model.numbers[n] for n in names if n in model.numbers]
        result[i] = model.emission[known].sum(axis=0)
    return result


def viterbi(emission: np.ndarray, transition: np.ndarray) -> list[int]:
    """The labels of the best path; on ties the smaller label."""
    if not len(emission):
        return []
    (a, b), back = emission[0].tolist(), []
    (aa, ab), (ba, bb) = transition.tolist()
    for x, y in emission[1:].tolist():
        back.append((int(b + ba > a + aa), int(b + bb > a + ab)))
        a, b = x + max(a + aa, b + ba), y + max(a + ab, b + bb)
    path = [int(b > a)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Model:
    """Fit on ``(features, labels)`` pages: all pages in one padded array, forward-backward over positions."""
    pages = [p for p in pages if p[0]]
    numbers = {name: i for i, name in enumerate(sorted({n for page, _ in pages for names in page for n in names}))}
    longest = max(len(p) for p, _ in pages)
    flat = np.array([numbers[n] for page, _ in pages for names in page for n in names])
    owner = np.repeat(np.arange(sum(len(p) for p, _ in pages)), [len(names) for page, _ in pages for names in page])
    length = np.array([len(p) for p, _ in pages])
    page_of = np.repeat(np.arange(len(pages)), length)
    place = np.concatenate([np.arange(n) for n in length])
    label = np.concatenate([np.array(y) for _, y in pages])
    live = np.arange(longest)[None, :] < length[:, None]
    truth = np.zeros((len(pages), longest), np.int64)
    truth[page_of, place] = label
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][live[:, 1:]], truth[:, 1:][live[:, 1:]]), 1)
    weights, moves = np.zeros((len(numbers), 2)), np.zeros((2, 2))
    speed_w, speed_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(ROUNDS):
        block = np.stack([np.bincount(owner, weights[flat, y], minlength=len(owner) and owner[-1] + 1) for y in (0, 1)], axis=1)
        emission = np.zeros((len(pages), longest, 2))
        emission[page_of, place] = block
        forward = emission.copy()
        for t in range(1, longest):
            forward[:, t] += np.where(live[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1), 0)
        backward = np.zeros_like(emission)
        for t in range(longest - 2, -1, -1):
            after = np.logaddexp.reduce(moves[None] + (emission[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], after, 0)
        total = np.logaddexp.reduce(forward[np.arange(len(pages)), length - 1], axis=1)
        each = np.exp(forward + backward - total[:, None, None])[page_of, place]
        pair = forward[:, :-1, :, None] + moves + (emission[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = np.exp(np.where(live[:, 1:, None, None], pair, -np.inf)).sum(axis=(0, 1))
        rest = np.eye(2)[label] - each
        slope = np.stack([np.bincount(flat, rest[owner, y], minlength=len(numbers)) for y in (0, 1)], axis=1) / len(pages) - PENALTY * weights / len(pages)
        slope_m = (seen - expected) / len(pages) - PENALTY * moves / len(pages)
        speed_w += slope**2
        speed_m += slope_m**2
        weights += RATE * slope / np.sqrt(speed_w)
        moves += RATE * slope_m / np.sqrt(speed_m)
    return Model(numbers, weights, moves)


def weak_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: inside ``<article>`` or ``<main>`` and in nothing that is for something else."""
    if not any("article" in b.tags or "main" in b.tags for b in page):
        return None
    other = {"nav", "aside", "footer", "form", "button", "figure"}
    return [int(("article" in b.tags or "main" in b.tags) and not other & set(b.tags) and not b.names & BOILERPLATE_NAMES) for b in page]


def training_pages(samples: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """The labelled pages of this package, and sampled pages that mark their article; each also without the marks."""
    marks = frozenset({"article", "main"}) | ARTICLE_NAMES
    result = []
    for text in PAGES:
        page = blocks(text)
        labels = [int(b.label == "main") for b in page]
        result += [(features(page), labels), (features(page, marks), labels)] * 4
    for text in samples:
        page = blocks(text)
        labels = weak_labels(page)
        if labels:
            result += [(features(page), labels), (features(page, marks), labels)]
    return result


def fit(pages: DataFrame) -> Model:
    """Train on the labelled pages and at most ``SAMPLE_PAGES`` pages of the table, chosen by a hash of their ids."""
    short = pages.where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id").distinct()
    ids = [r[0] for r in short.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    known = [i for i in ids if i is not None]
    # An id that several pages carry stands for the smallest of them.
    texts = pages.where(F.col("page_id").isin(known)).where(F.octet_length("html") <= SAMPLE_BYTES).groupBy("page_id").agg(F.min("html")).select("min(html)").collect() if known else []
    return train(training_pages(sorted(r[0] for r in texts)))


def main_text(page: str, model: Model) -> str:
    found = blocks(page)
    labels = viterbi(scores(model, features(found)), model.transition)
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    A null or empty page, or one without an article, has an empty text; a cut or broken page is read as far as it
    goes, a long one whole; of two equally good labellings of a page the one with fewer article blocks at the first
    difference is taken; repeated rows and ids give a row each; other columns are ignored; an empty table gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), sent.value) if p.is_valid else "" for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
