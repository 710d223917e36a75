"""Trees from histograms against MLlib's own, which has the same rule."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from evq.operators import boosting, ml

FEATURES = ["a", "b", "c"]
AXES = {"learning_rate": 0.3, "max_depth": 3, "min_child_samples": 5}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 1200
    a, b, c = (rng.integers(0, k, n).astype(float) for k in (9, 20, 3))
    label = (a + b / 4 + rng.normal(0, 3, n) > 6).astype(int)
    rows = [(f"e{i}", *map(float, r), int(y), float(w)) for i, (*r, y, w) in enumerate(zip(a, b, c, label, rng.integers(0, 4, n)))]
    return spark.createDataFrame(rows, "id string, a double, b double, c double, label int, weight double").repartition(3, "id").persist()


def _shape(model):
    text = model.trees[0].toDebugString.split("\n", 1)[1]
    return [line.split("Predict:")[0] for line in text.splitlines()]


def test_trees_are_those_of_mllib(table, monkeypatch):
    monkeypatch.setattr(boosting, "STEP", 2)  # responses are kept several times
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table)
    want = GBTClassifier(featuresCol="x", weightCol="weight", maxIter=6, stepSize=0.3, maxDepth=3, minInstancesPerNode=5, seed=1).fit(rows)
    model = ml.fit_classifier(table, FEATURES, AXES, 6)
    got = ml._trees(model)
    assert got.treeWeights == want.treeWeights and [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    assert _shape(got) == _shape(want)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    one, two = (m.orderBy("id").select("s").collect() for m in (ml.with_score(table, model, "s"), want.transform(rows).select("id", ml.vector_to_array("probability")[1].alias("s"))))
    assert [r[0] for r in one] == pytest.approx([r[0] for r in two], abs=1e-9)
    monkeypatch.setattr(boosting, "FEW_SPLITS", -1)  # a tree is followed node by node
    assert ml.gain_importances(ml.fit_classifier(table, FEATURES, AXES, 2)) == pytest.approx(ml.gain_importances(ml.first_rounds(model, 2)))


def test_losses_are_those_of_mllib(table):
    held = F.hash("id") % 3 == 0
    model = ml.fit_classifier(table.filter(~held), FEATURES, AXES, 4)
    rows = table.filter(held)
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    with boosting.binned(table, FEATURES, held, ml.MISSING) as b:
        grown = ml._grown(b, [FEATURES], ml.train_axes(**AXES), 4)
        assert boosting.losses(b, grown)[0] == pytest.approx(ml._trees(model).evaluateEachIteration(rows))


@pytest.mark.parametrize("operator", [ml.iterative_add_auc, ml.iterative_remove_auc])
def test_all_lists_grow_in_the_same_passes(table, monkeypatch, operator):
    passes = []
    one = boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda blocks, fits, since: passes.append(len(fits)) or one(blocks, fits, since))
    assert operator(table, "id", FEATURES, AXES, 2).count() == 3
    assert len(passes) <= 2 * 3 and passes[0] == 3


def test_aucs_are_those_of_single_fits(table):
    got = {r["feature"]: r["auc"] for r in ml.iterative_remove_auc(table, "id", FEATURES, AXES, 3).collect()}
    marked = table.withColumn("split", ml.split_label("id", 0.33))
    for left_out in FEATURES:
        model = ml.fit_classifier(marked, [f for f in FEATURES if f != left_out], AXES, 3, F.col("split") == "test")
        assert got[left_out] == pytest.approx(ml.weighted_auc(ml.with_score(marked.filter("split = 'test'"), model)).first()[0], abs=1e-9)


def test_scan_bins_its_rows_once(table, monkeypatch):
    made = []
    once = boosting.binned
    monkeypatch.setattr(boosting, "binned", lambda *a: made.append(1) or once(*a))
    assert ml.parameter_scan(table, "id", FEATURES, {"max_depth": [1, 2], "learning_rate": [0.1, 0.2]}, 2).count() == 4
    assert made == [1]


def test_bins():
    values = np.repeat(np.arange(100.0), 3)
    known, weights = boosting._summary(values, np.ones(300), 1024)
    assert len(known) == 100 and set(weights) == {3.0}
    points = boosting.cut_points(known, weights)
    assert len(points) == boosting.BINS - 1 and set(points % 1) == {0.5}
    counts = np.bincount(np.searchsorted(points, values))
    assert counts.min() >= 6 and counts.max() <= 12
    assert list(boosting.cut_points(np.array([-np.inf, ml.MISSING, 0.0, np.inf]), np.ones(4))) == [-np.inf, ml.MISSING / 2, 0.0]
    short, weights = boosting._summary(np.arange(10000.0), np.ones(10000), 50)
    assert len(short) <= 51 and weights.sum() == 10000 and short[-1] == 9999 and weights.max() <= 2 * 200


def test_wrong_rows_are_refused(table):
    with pytest.raises(Exception, match="label must be 0 or 1"):
        ml.fit_classifier(table.withColumn("label", F.lit(2)), FEATURES, AXES, 1)
    with pytest.raises(Exception, match="weight at least 0"):
        ml.fit_classifier(table.withColumn("weight", F.lit(-1.0)), FEATURES, AXES, 1)
    with pytest.raises(ValueError, match="no training rows"):
        ml.fit_classifier(table.limit(0), FEATURES, AXES, 1)
