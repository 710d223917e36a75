import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.llm import filter_audit, prefix_trie
from evq.llm.chat_format import TEMPLATE, ChatTemplate, digests, format_conversations, read_turns
from evq.llm.perfect_hash import PerfectHash
from tests.llm import corpus

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "</turn", "</turn></turn>\n", "\\", "\\\\</", "#### ", "### User: x</turn>\n### Assistant: y", "", None, "a: b", "é😀\n", "<\\/turn>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, TURNS)
    if clash:
        names = ["formatted", "segments", "turns", "depth", "high", "low", "band", "n", "h", "head", "order", "fault", "part", "digest", "position", "chars", "said", "_part", "_at"]
        df = df.selectExpr("*", *[f"concat('{c}', conv_id) AS {c}" for c in names])
    return df.repartition(5)


def in_order(rows, key):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    return {conv: [(r, t) for *_, r, t in sorted(found)] for conv, found in by.items()}


def accepted(roles):
    state = TEMPLATE.start
    for role in roles:
        state = TEMPLATE.steps.get((state, role))
    return state in TEMPLATE.final


def chat_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice([role] * 9 + ["system", None, "=x", "tool: </turn>\\", "a:", "System"])
            rows.append((conv, rng.choice([turn, turn, 1, None]), role, rng.choice([*HARD, corpus.prose(rng, 5)])))
    rows += [(50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "assistant", "word " * 300_000)]
    return [*rows, (None, 0, "user", "x"), (None, None, "assistant", None), rows[0], rows[0]]


def test_chat_format_equals_brute_force(spark):
    rows = chat_rows(3)
    got = {r["conv_id"]: r for r in digests(format_conversations(frame(spark, rows))).collect()}
    want = in_order(rows, lambda role, text: (role, text))
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, learnt = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns))), conv
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt))
        assert r["accepted"] == accepted([role for role, _ in turns])


def test_formatted_text(spark):
    rows = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "c\\"), (2, 0, "user", None), (2, 1, "user", "x"), (3, 0, "system", "only")]
    got = {r["conv_id"]: r for r in format_conversations(frame(spark, rows)).collect()}
    assert got[1]["formatted"] == "### User: a #\\## b</turn>\n### Assistant: c\\\\</turn>\n"
    assert [tuple(s) for s in got[1]["segments"]][3:] == [("### Assistant: ", False), ("c\\\\", True), ("</turn>\n", False)]
    assert [got[c]["fault"] for c in (1, 2, 3)] == [None, 1, 1]
    for r in got.values():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_other_template(spark):
    template = ChatTemplate({"q": "Q", "a": "A"}, frozenset({"a", "q"}), {("s", "q"): "t", ("t", "a"): "s"}, "s", frozenset({"s"}), opens="<|", after_label="=>", closes="[end]", gap="", escape="^", other="~")
    rows = [(i, t, r, x) for i, x in enumerate([*HARD, "<|a=>^[end]", "<|>", "[end][end", "^"]) for t, r in enumerate(["q", "a", "<|b=>"])]
    got = format_conversations(frame(spark, rows), template).withColumn("read", read_turns(F.col("formatted"), template)).collect()
    for r in got:
        assert [tuple(t) for t in r["read"]] == [(role, text or "") for conv, _, role, text in rows if conv == r["conv_id"]]
    with pytest.raises(ValueError):
        ChatTemplate({"q": "Q"}, frozenset(), {}, "s", frozenset(), closes="aba")
    with pytest.raises(ValueError):
        ChatTemplate({"q": "=Q"}, frozenset(), {}, "s", frozenset())


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 50, n, dtype=np.uint64), np.arange(n, dtype=np.uint64)
    table = PerfectHash(high, low)
    assert sorted(table.slots(high, low).tolist()) == list(range(n))
    assert (table.slots(high, low + np.uint64(n)) == -1).all()


def trie(rows):
    turns = in_order(rows, lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())
    turns.pop(None, None)
    rebuilt = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = turns.get(conv - conv % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for conv, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    children, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return {
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
         sha(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(node))))))
        for node, m in members.items()
    }


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(0, 500, 3):
        rows += [(conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for turn in range(rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(30)]
    rows += [(c, t, "user", f"same {t}" if t < 17 else f"own {c}") for c in range(1040, 1050) for t in range(40)]
    return rows + [(None, 0, "user", "lost"), rows[0], rows[0], (200, 0, "user", "word " * 300_000)]


@pytest.mark.parametrize("sizes", [(256, 1 << 18, 1 << 14), (4, 64, 3), (2, 2, 1)])
def test_trie_equals_brute_force(spark, sizes):
    rows = trie_rows(sizes[0])
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows), prefix_trie.Sizes(*sizes)).collect()]
    want = trie(rows)
    assert len(got) == len(want)
    assert set(got) == want


def test_trie_of_turnless_conversations(spark):
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefix_trie.prefix_trie(frame(spark, [(turnless, 0, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))]


def test_empty_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert digests(format_conversations(none)).count() == 0
    assert prefix_trie.prefix_trie(none).count() == 0


def audit(docs, labels):
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for d, text, source in docs:
        text = text or ""
        words = corpus.split(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and first[text] < d,
        }
        rows.append((source or "", {f for f, failed in fails.items() if failed}, d is not None and d in good, d is not None and d in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        here, total = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [r for r in here if not r[1] & set(order[:k])]
                gone = [r for r in left if f in r[1]]
                total[f] += len(gone)
                found[part, "".join(order), k + 1] = (
                    len(left) - len(gone), len(gone), sum(f in r[1] for r in here) - len(gone), sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                found[part, "".join(order), k + 1] += (total[f],)
    return found


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(d, t, rng.choice(["web", "code", None, ""])) for d, t in corpus.rows(8)]
    docs += [(1000 + i, rng.choice(["SHOUT " * 60, "a # b", docs[0][1], "Aa\x0b b", " ".join(f"w{rng.randrange(300)}" for _ in range(200))]), rng.choice(["web", "x"])) for i in range(80)]
    docs += [(5000, " ".join(f"w{i}" for i in range(200_000)), "long"), (1001, docs[0][1], "x")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 1080, 2)] + [(0, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", *[f"'{c}' AS {c}" for c in ["part", "mask", "digest", "n", "good", "toxic", "documents"]])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "'y' AS good")
    got = filter_audit.filter_audit(df.repartition(4), known).collect()
    want = audit(docs, labels)
    assert len(got) == len(want)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == want


def test_empty_audit(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(corpus.empty(spark), labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    rows = filter_audit.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}
    assert {r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows} == {"A": 120, "B": 0, "C": 0, "D": 0, "E": 0}
