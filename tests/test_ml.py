import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evq import config
from evq.operators import ml
from evq.operators.ranking import weighted_auc

AXES = {"learning_rate": 0.3, "max_depth": 2, "min_child_samples": 5}
ROUNDS = 4


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 1500
    label = (rng.random(n) < 0.5).astype(int)
    good = rng.normal(label * 1.5, 1.0)
    weak = rng.normal(label * 0.4, 1.0)
    noise = rng.normal(0, 1, n)
    rows = [
        (f"e{i}", float(a), float(b), float(c), int(y), float(w), bool(i % 3), i % 2)
        for i, (a, b, c, y, w) in enumerate(zip(good, weak, noise, label, rng.random(n) + 0.5))
    ]
    df = spark.createDataFrame(
        rows, "id string, good double, weak double, noise double, label int, weight double, reg2j2b boolean, OS int"
    )
    return df.repartition(4, "id").persist()


FEATURES = ["good", "weak", "noise"]


@pytest.fixture(scope="module")
def model(table):
    return ml.fit_classifier(table, FEATURES, AXES, ROUNDS)


def test_fit_and_score(table, model):
    scored = ml.with_score(table, model)
    assert scored.columns == [*table.columns, "score"]
    assert weighted_auc(scored).first()["auc"] > 0.8
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1
    raw = ml.with_score(table, model, "raw", raw=True).agg(F.min("raw"), F.max("raw")).first()
    assert raw[0] < 0 < raw[1]
    assert ml.ignored_axes({"num_leaves": 3, "max_depth": 2}) == ["num_leaves"]


def test_patience():
    assert ml.best_round([0.5, 0.6, 0.4, 0.3, 0.35, 0.36], 2) == 4
    assert ml.best_round([0.5, 0.6, 0.7, 0.4], 2) == 1  # the gain comes after patience has run out
    assert ml.best_round([0.5, 0.4, 0.3], 10) == 3
    assert ml.best_round([float("nan")] * 3, 1) == 3


def test_early_stop_keeps_the_best_round(table):
    # Validation rows whose labels are noise: more rounds only fit what does not hold there.
    noisy = table.withColumn("label", F.when(F.hash("id") % 4 == 0, F.pmod(F.hash("id", F.lit(3)), F.lit(2)).cast("int")).otherwise(F.col("label")))
    rule = F.hash("id") % 4 == 0
    stopped = ml.fit_classifier(noisy, FEATURES, AXES, 8, rule, patience=3)
    full = ml.fit_classifier(noisy.filter(~rule), FEATURES, AXES, 8)
    assert ml.best_iteration(full) == 8 and ml.best_iteration(stopped) < 8
    assert stopped.stages[-1].trees[0].toDebugString.split("\n", 1)[1] == full.stages[-1].trees[0].toDebugString.split("\n", 1)[1]


def test_a_cut_model_is_the_shorter_fit(table, folder, monkeypatch):
    long, short = ml.fit_classifier(table, FEATURES, AXES, 5), ml.fit_classifier(table, FEATURES, AXES, 3)
    fits = []
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: fits.append(rows))
    cut = ml.first_rounds(long, 3)
    assert not fits and ml.best_iteration(cut) == 3 and ml.first_rounds(long, 9) is long
    scores = [ml.with_score(table, m).orderBy("id").select("id", "score").collect() for m in (cut, short)]
    assert scores[0] == scores[1]
    assert ml.gain_importances(cut) == pytest.approx(ml.gain_importances(short))
    cut.save(f"{folder}/cut")
    again = ml.PipelineModel.load(f"{folder}/cut")
    assert ml.with_score(table, again).orderBy("id").select("id", "score").collect() == scores[0]


def test_node_table(spark, folder):
    # Two rounds of depth one; the second feature is categorical and the better one.
    rows = [(f"e{i}", float(i % 4 in (0, 2)), float(i % 4), float(i % 5), int(i % 4 in (1, 2) if i % 10 else i % 20 > 0), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, a double, kind double, c double, label int, weight double")
    model = ml.fit_classifier(df, ["kind", "c"], {"max_depth": 2, "min_child_samples": 1}, 3)
    nodes = ml.node_table(model, f"{folder}/m").collect()
    inner = [n for n in nodes if n["left"] is not None]
    assert len(nodes) == sum(t.numNodes for t in model.stages[-1].trees) and all(n["feature"] in ("kind", "c") and n["threshold"] is not None for n in inner)
    assert all(n["gain"] is None and n["feature"] is None for n in nodes if n["left"] is None)
    by_text = [len(re.findall(f"If \\(feature {i} ", model.stages[-1].toDebugString)) for i in (0, 1)]
    assert [sum(n["feature"] == f for n in inner) for f in ("kind", "c")] == by_text and sum(by_text) > 3
    assert ml.split_importances(model) == {f: n / sum(by_text) for f, n in zip(("kind", "c"), by_text, strict=True)}
    # A categorical split names the categories that go left.
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    stages = [VectorAssembler(inputCols=["_in_kind"], outputCol="_raw_features"), VectorIndexer(inputCol="_raw_features", outputCol="_features", maxCategories=8)]
    indexed = Pipeline(stages=stages).fit(df.withColumn("_in_kind", F.col("kind")))
    trees = GBTClassifier(featuresCol="_features", maxDepth=1, maxIter=1).fit(indexed.transform(df.withColumn("_in_kind", F.col("kind"))))
    whole = ml.PipelineModel([VectorAssembler(inputCols=["_in_kind"], outputCol="_features"), trees])
    top = [n for n in ml.node_table(whole, f"{folder}/c").collect() if n["left"] is not None]
    assert [(n["feature"], n["threshold"], set(n["categories"]) in ({1.0, 2.0}, {0.0, 3.0})) for n in top] == [("kind", None, True)]
    assert ml.split_importances(whole) == {"kind": 1.0}


def test_boosted_in_closed_form(spark):
    """Two rounds of depth one on a feature of two values, in plain Python."""
    import math

    rows = [(f"e{i}", float(i % 3 == 0), int(i % 7 < (4 if i % 3 == 0 else 2)), 1.0 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, x double, label int, weight double")
    got = {r["x"]: r["score"] for r in ml.with_score(df, ml.fit_classifier(df, ["x"], {"max_depth": 1, "min_child_samples": 1, "learning_rate": 0.1}, 2)).select("x", "score").distinct().collect()}
    for x in (0.0, 1.0):
        here = [(2 * y - 1, w) for _, v, y, w in rows if v == x]
        f = sum(y * w for y, w in here) / sum(w for _, w in here)
        f += 0.1 * sum(w * 4 * y / (1 + math.exp(2 * y * f)) for y, w in here) / sum(w for _, w in here)
        assert got[x] == pytest.approx(1 / (1 + math.exp(-2 * f)), abs=1e-9)


def test_scan_goes_on_where_it_stopped(spark, table, folder, monkeypatch):
    grid = {"max_depth": [1, 2]}
    first = ml.parameter_scan(table, "id", FEATURES, {"max_depth": [1]}, 2, results=f"{folder}/scan").collect()
    trained = []
    train = ml._train_and_judge
    monkeypatch.setattr(ml, "_train_and_judge", lambda t, k, f, p, r: trained.append(p) or train(t, k, f, p, r))
    both = ml.parameter_scan(table, "id", FEATURES, grid, 2, results=f"{folder}/scan").orderBy("name").collect()
    assert trained == [{"max_depth": 2}] and both[0] == first[0] and len(both) == 2
    again = ml.parameter_scan(table.repartition(3), "id", FEATURES, grid, 2, results=f"{folder}/scan").orderBy("name").collect()
    assert again == both and len(trained) == 1
    # Another table, other features, rounds or split: nothing of the old results is taken.
    changed = table.withColumn("good", F.when(F.col("id") == "e7", -1.0).otherwise(F.col("good")))
    for n, (df, features, rounds, size) in enumerate([(changed, FEATURES, 2, 0.4), (table, FEATURES[:2], 2, 0.4), (table, FEATURES, 1, 0.4), (table, FEATURES, 2, 0.3)], 2):
        ml.parameter_scan(df, "id", features, {"max_depth": [1]}, rounds, size, results=f"{folder}/scan")
        assert len(trained) == n
    assert spark.read.text(f"{folder}/scan/*/settings").count() == 5


def test_fingerprint(table):
    one = ml.table_fingerprint(table)
    assert ml.table_fingerprint(table.repartition(7).select(*reversed(table.columns))) == one
    assert ml.table_fingerprint(table.unionByName(table.limit(1))) != one != ml.table_fingerprint(table.drop("OS"))
    assert ml.table_fingerprint(table.limit(0)).endswith("-0-0-0")


def test_missing_values(table):
    # A feature that is missing more often for background: being missing must itself be usable.
    gaps = table.withColumn(
        "good", F.when((F.col("label") == 0) & (F.hash("id") % 3 != 0), None).when(F.hash("id") % 7 == 0, float("nan")).otherwise(F.col("good"))
    )
    fitted = ml.fit_classifier(gaps, FEATURES, AXES, ROUNDS)
    scored = ml.with_score(gaps, fitted)
    assert scored.columns == [*gaps.columns, "score"] and scored.filter("score IS NULL").count() == 0
    assert weighted_auc(scored).first()["auc"] > 0.85


def test_importance(spark, model):
    gain, split = ml.importances(model)
    assert sum(gain.values()) == pytest.approx(1) and sum(split.values()) == pytest.approx(1)
    assert max(gain, key=gain.get) == "good"
    rows = ml.feature_importance(model, spark).collect()
    assert rows[0]["feature"] == "good" and [r["gain"] for r in rows] == sorted((r["gain"] for r in rows), reverse=True)


def test_single_training_round_trip(spark, table, folder):
    fitted, summary = ml.single_training(
        table, "id", FEATURES, AXES, ROUNDS, selection="(reg2j2b == True)", extra={"region": "2j2b"}
    )
    row = summary.first()
    assert 0.75 < row["auc"] <= 1 and 0.75 < row["auc_train"] <= 1
    assert row["bad_ks"] == (row["ks_pvalue_sig"] < 0.2 or row["ks_pvalue_bkg"] < 0.2)
    assert row["features"] == FEATURES and row["selection_used"] == "(reg2j2b == True)"
    assert row["set_params"]["max_depth"] == 2.0 and row["ignored_params"] == ["num_leaves", "reg_lambda"]
    assert 1 <= row["best_iteration"] <= ROUNDS and len(row["response_histograms"]) == 120
    assert row["extra"] == {"region": "2j2b"}
    ml.save_training(fitted, summary, f"{folder}/t")
    again, about = ml.load_training(spark, f"{folder}/t")
    assert about["auc"] == row["auc"] and about["features"] == FEATURES
    one, two = (ml.apply_single(table, m).agg(F.sum("response")).first()[0] for m in (fitted, again))
    assert one == pytest.approx(two)


def test_folded_training(table):
    models, summary, curve, shares = ml.folded_training(table, "id", FEATURES, AXES, 2, k=3)
    row = summary.first()
    assert len(models) == 3 and row["folds"] == 3 and 0.75 < row["auc"] < 1 and -1 < row["score"] < -0.75
    points = curve.orderBy("point").collect()
    assert len(points) == 100 and points[0]["tpr"] == 0.0 and points[-1]["tpr"] == 1.0
    assert sum(r["importance"] for r in shares.collect()) == pytest.approx(1)
    scored = ml.apply_folded(table, models)
    each = [ml.apply_single(table, m).orderBy("id").select("response").collect() for m in models]
    want = np.mean([[r[0] for r in rows] for rows in each], axis=0)
    assert [r[0] for r in scored.orderBy("id").select("response").collect()] == pytest.approx(want)


def test_masked_scores(table, model):
    selection = "(reg2j2b == True) & (OS == True)"
    scored = ml.apply_single(table, model, selection=selection)
    outside = scored.filter("NOT (reg2j2b AND OS = 1)")
    assert outside.filter(f"response <> {config.UNSCORED}").count() == 0
    assert scored.filter("reg2j2b AND OS = 1").filter("response BETWEEN 0 AND 1").count() == table.filter("reg2j2b AND OS = 1").count()
    # an existing column keeps its values outside the selection
    second = ml.apply_single(scored, model, selection="OS == 0")
    assert second.filter(f"response = {config.UNSCORED}").count() == table.filter("OS = 1 AND NOT reg2j2b").count()
    every = ml.apply_all(table, "id", [([model], selection), ([model, model], "OS == 0")])
    assert every.columns == ["id", "response"] and every.count() == table.count()
    assert every.filter(f"response = {config.UNSCORED}").count() == table.filter("OS = 1 AND NOT reg2j2b").count()
    assert ml.apply_all(table.limit(0), "id", [([model], selection)]).count() == 0
    assert ml.apply_all(table, "id", []).filter(f"response <> {config.UNSCORED}").count() == 0


def test_combine_scores(table):
    df = table.select("id", "OS", "reg2j2b", F.lit(0.25).alias("a"), F.lit(0.75).alias("b"))
    got = ml.combine_scores(df, [("OS == 1", "a"), ("OS == 1 && reg2j2b", "b")])
    counts = {r["response"]: r["count"] for r in got.groupBy("response").count().collect()}
    assert counts == {
        config.UNSCORED: df.filter("OS = 0").count(),
        0.25: df.filter("OS = 1 AND NOT reg2j2b").count(),
        0.75: df.filter("OS = 1 AND reg2j2b").count(),
    }


def test_grid():
    assert len(ml.grid_points()) == 100
    assert ml.grid_points({"max_depth": [2, 3], "num_leaves": [1, 2, 3]}) == [{"max_depth": 2}, {"max_depth": 3}]


def test_scan(table):
    grid = {"max_depth": [1, 2], "num_leaves": [8, 16], "learning_rate": [0.3], "min_child_samples": [5]}
    rows = ml.parameter_scan(table, "id", FEATURES, grid, 2, parallelism=2).collect()
    assert sorted(r["name"] for r in rows) == [
        "max_depth-1_learning_rate-0.3_min_child_samples-5",
        "max_depth-2_learning_rate-0.3_min_child_samples-5",
    ]
    assert all(r["auc"] > 0.7 for r in rows)


def test_feature_ranking_by_fits(table):
    ranked = ml.feature_importances_repeated(table, "id", FEATURES, AXES, 2, n_fits=2).collect()
    assert ranked[0]["feature"] == "good" and len(ranked) == 3
    removed = ml.iterative_remove_auc(table, "id", FEATURES, AXES, 2).collect()
    assert removed[0]["feature"] == "good" and removed[0]["auc"] < removed[-1]["auc"]
    added = ml.iterative_add_auc(table, "id", FEATURES, AXES, 2, max_features=2).orderBy("n").collect()
    assert [(r["n"], r["feature"]) for r in added] == [(1, "good"), (2, "weak")]


def test_feature_columns(table):
    df = table.select("id", "good", "weak", "label", "weight", F.lit("train").alias("split"))
    assert ml.feature_columns(df, "id") == ["good", "weak"]


def test_save_feature_result(spark, folder):
    from evq.operators.features import save_feature_result

    save_feature_result(f"{folder}/r", {"candidates": ["a", "b"], "aucs": [0.5, 0.6]})
    assert spark.read.json(f"{folder}/r").first().asDict() == {"candidates": ["a", "b"], "aucs": [0.5, 0.6]}
