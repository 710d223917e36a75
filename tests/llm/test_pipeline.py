"""The pipeline on a small corpus: each stage's decisions take effect on what the next one gets."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from evq.llm import queries
from evq.llm.tasks import written
from evq.plans import session
from llm import corpus


def folder_of(spark, folder):
    rng = random.Random(4)

    def prose(n):  # few words, so that good documents resemble each other
        return corpus.prose(rng, n, 4)

    item = prose(15)
    passage = prose(70)
    pairs = [(i, prose(90)) for i in range(40)]
    words = pairs[0][1].split(" ")
    pairs.append((40, " ".join(words[:50] + ["new"] + words[51:])))  # near copy
    pairs.append((41, pairs[1][1]))  # exact copy
    pairs += [(42, f"{prose(60)} {passage}"), (43, f"{prose(60)} {passage} {prose(30)}")]
    pairs += [(44, f"{prose(60)} {item} {prose(20)}"), (45, "too short"), (46, None)]
    pairs += [(60 + i, " ".join(f"{w}###" for w in prose(90).split(" "))) for i in range(12)]
    corpus.frame(spark, pairs, False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1) for i in range(20)] + [(60 + i, 0) for i in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return dict(pairs), passage, item


def test_stages(spark, folder):
    texts, passage, item = folder_of(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test")
        if name != "packing":
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, single, short, clean = kept
    assert set(good) == set(range(45)) and all(good[d] == texts[d] for d in good)
    assert set(single) == set(good) - {40, 41}
    assert passage in short[42] and passage not in short[43] and short[43].split() == [w for w in texts[43].replace(passage, "").split()]
    assert all(short[d] == texts[d] for d in short if d != 43)
    assert item in short[44] and item not in clean[44] and len(clean[44].split()) == 80
    assert all(clean[d] == short[d] for d in clean if d != 44)
    assert {r["doc_id"] for r in docs.collect()} == set(clean)
    shared = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    again = corpus_pipeline.run(spark, folder)
    made = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before}
    assert made == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES}  # what the stages wrote on the way is gone
    assert sorted(map(str, again.drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "repeats", "benchmark", "packing"]


def test_nulls_and_clashing_columns(spark, folder):
    """Null ids and texts, repeated rows and columns named as the stages' own: the columns stay, clean rows keep their values."""
    folder_of(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.where("doc_id IN (2, 3)").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where("doc_id = 4"))
    names = ["spans", "place", "mark", "_row", "kept", "score", "class_id", "first", "_key"]
    docs = docs.unionByName(extra)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test")
        if name != "packing":
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r[n] == n + ("" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for n in names)
            assert {0, 5, 42} <= {r["doc_id"] for r in rows}


def test_empty_tables(spark, folder):
    texts, _, _ = folder_of(spark, folder)
    whole = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark", "labels")}
    for n, rows in whole.items():
        rows.limit(0).write.parquet(f"{folder}/empty/{n}.parquet")
    docs = whole["documents"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, f"{folder}/empty"), "test")
        assert docs.count() == 0 and (name == "packing" or docs.columns == whole["documents"].columns)
    kept = corpus_pipeline.STAGES[0][1](spark, whole["documents"], f"{folder}/empty")  # without labels the rules alone decide
    assert kept.columns == whole["documents"].columns and 45 not in {r["doc_id"] for r in kept.collect()}
