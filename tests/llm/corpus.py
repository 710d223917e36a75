"""Small odd tables for the tests: nulls, empty and long texts, repeated rows, clashing column names."""

import random
import re

WORDS = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASH = ["place", "mark", "id", "spans", "_row", "_new", "_words", "_runs", "_items", "group", "path", "score", "kept", "n_words", "class_id", "start", "length", "toxic", "_rank", "own_licence"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.', 'é'])}" for _ in range(n))


def rows(seed=1, n=60):
    """``(doc_id, text)``: prose with shared passages, near and exact copies, junk, empty texts, null ids."""
    rng = random.Random(seed)
    passages = [prose(rng, k) for k in (12, 49, 50, 55, 80, 140)]
    texts = []
    for i in range(n):
        words = prose(rng, rng.choice([3, 20, 60, 120, 300])).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages).split(" ")
        texts.append(rng.choice([" ", " ", "\n", "  \t"]).join(words))
    texts += [texts[2]] * 3 + [None, "", " \n\t ", "one", "one two three four", " x y"]
    for k in range(4):
        words = prose(random.Random(5), 150).split(" ")
        words[20 + 30 * k] = "changed"
        texts.append(" ".join(words))
    texts.append(prose(rng, 4000, 50))
    found = list(enumerate(texts))
    rng.shuffle(found)
    return found + [(None, texts[0]), (None, passages[5]), (found[0][0], found[0][1]), (7, texts[9])]


def frame(spark, pairs, clash=True):
    df = spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in pairs], SCHEMA)
    if clash:
        df = df.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in CLASH])
    return df.repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return WORDS.findall(text or "")
