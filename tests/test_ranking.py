import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.operators import ml, ranking


def roc_points(score, label, weight):
    """Weighted curve by brute force: one point per distinct score, descending, with the origin."""
    points = [(0.0, 0.0)]
    for s in sorted(set(score), reverse=True):
        here = score >= s
        points.append((weight[here & (label == 0)].sum(), weight[here & (label == 1)].sum()))
    points = np.array(points)
    return points / points[-1]


def area(points):
    return float(np.trapezoid(points[:, 1], points[:, 0]))


def random_sample(n, seed, ties=False, spread=1.0):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.4).astype(int)
    score = np.clip(rng.normal(0.45 + 0.1 * label, 0.2), 0, 1) * spread
    if ties:
        score = np.round(score, 2)
    weight = rng.random(n)
    fold = rng.integers(0, 3, n)
    return score, label, weight, fold


def frame(spark, score, label, weight, fold):
    rows = [(float(s), int(y), float(w), int(f)) for s, y, w, f in zip(score, label, weight, fold)]
    return spark.createDataFrame(rows, "score double, label int, weight double, fold int").repartition(6)


@pytest.mark.parametrize("ties, spread", [(False, 1.0), (True, 1.0), (False, 5000.0), (False, -300.0)])
def test_auc_and_curve_equal_brute_force(spark, ties, spread):
    data = random_sample(1500, 11, ties, spread)
    df = frame(spark, *data)
    score, label, weight, fold = data
    assert ranking.weighted_auc(df).first()["auc"] == pytest.approx(area(roc_points(score, label, weight)))
    got = {r["fold"]: r["auc"] for r in ranking.weighted_auc(df, by=["fold"]).collect()}
    for f in range(3):
        here = fold == f
        points = roc_points(score[here], label[here], weight[here])
        assert got[f] == pytest.approx(area(points))
        curve = ranking.roc_curve(df.filter(F.col("fold") == f)).orderBy(F.col("threshold").desc()).collect()
        assert np.array([[r["fpr"], r["tpr"]] for r in curve]) == pytest.approx(points[1:])
        assert [r["threshold"] for r in curve] == pytest.approx(sorted(set(score[here]), reverse=True))


@pytest.mark.parametrize("scale, shift", [(1e-12, 0.0), (1e11, 0.0), (1e-300, 0.0), (1e300, 0.0), (1e-9, 1.0), (-1e5, -3.0)])
def test_auc_of_any_range(spark, scale, shift):
    score, label, weight, fold = random_sample(800, 5)
    score = score * scale + shift
    score[:2] = 0.0, -0.0
    df = frame(spark, score, label, weight, fold)
    points = roc_points(score, label, weight)
    assert ranking.weighted_auc(df).first()["auc"] == pytest.approx(area(points))
    curve = ranking.roc_curve(df).orderBy(F.col("threshold").desc()).collect()
    assert np.array([[r["fpr"], r["tpr"]] for r in curve]) == pytest.approx(points[1:])


def test_auc_separates_close_scores(spark):
    df = spark.range(1000).select((F.col("id") * 1e-12).alias("score"), (F.col("id") >= 500).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    assert ranking.weighted_auc(df).first()["auc"] == 1.0
    assert ranking.roc_curve(df).count() == 1000


@pytest.mark.parametrize("value", ["NULL", "double('NaN')"])
def test_missing_scores_are_refused(spark, value):
    df = spark.sql(f"SELECT {value} AS score, 1 AS label, 1.0D AS weight")
    with pytest.raises(Exception, match="null or NaN"):
        ranking.weighted_auc(df).collect()


def test_auc_properties(spark):
    df = frame(spark, *random_sample(900, 3, ties=True))
    auc = ranking.weighted_auc(df).first()["auc"]
    mirrored = ranking.weighted_auc(df.withColumn("score", -F.col("score"))).first()["auc"]
    assert mirrored == pytest.approx(1 - auc)
    one_class = ranking.weighted_auc(df.filter("label = 1")).first()["auc"]
    assert one_class is None
    same = ranking.weighted_auc(df.withColumn("score", F.lit(0.5))).first()["auc"]
    assert same == pytest.approx(0.5)


def test_auc_plan_windows_are_partitioned(spark, capsys):
    ranking.weighted_auc(frame(spark, *random_sample(50, 1)), by=["fold"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange SinglePartition" not in plan and "Join" not in plan


def test_mean_roc_equals_numpy(spark):
    score, label, weight, fold = random_sample(1200, 21, ties=True)
    df = frame(spark, score, label, weight, fold)
    grid = np.linspace(0, 1, 100)
    curves, aucs = [], []
    for f in range(3):
        points = roc_points(score[fold == f], label[fold == f], weight[fold == f])
        aucs.append(area(points))
        curves.append(np.interp(grid, points[:, 0], points[:, 1]))
        curves[-1][0] = 0.0
    mean = np.mean(curves, axis=0)
    mean[-1] = 1.0
    rows = ranking.mean_roc(df).orderBy("point").collect()
    assert [r["fpr"] for r in rows] == pytest.approx(grid)
    assert [r["tpr"] for r in rows] == pytest.approx(mean)
    summary = ranking.fold_summary(df).first()
    assert summary["auc"] == pytest.approx(np.trapezoid(mean, grid))
    assert summary["auc_std"] == pytest.approx(np.std(aucs))
    assert summary["score"] == pytest.approx(-np.mean(aucs)) and summary["folds"] == 3


def test_response_histograms(spark):
    score, label, weight, fold = random_sample(1500, 9)
    df = frame(spark, score, label, weight, fold).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))
    rows = ranking.response_histograms(df, nbins=30).orderBy("split", "label", "bin").collect()
    lo, hi = score[label == 0].min(), score[label == 1].max()
    edges = np.linspace(lo, hi, 31)
    shapes = {}
    for split, test in (("test", fold == 0), ("train", fold != 0)):
        for y in (0, 1):
            here = test & (label == y)
            want, _ = np.histogram(score[here], edges, weights=weight[here], density=True)
            got = [r["count"] for r in rows if r["split"] == split and r["label"] == y]
            assert got == pytest.approx(want)
            shapes[split, y] = want
    ks = ranking.response_ks(ranking.response_histograms(df)).first()
    for y, name in ((1, "sig"), (0, "bkg")):
        a, b = shapes["train", y], shapes["test", y]
        assert ks[f"ks_test_{name}"] == pytest.approx(np.abs(a / a.sum() - b / b.sum()).max(), abs=1e-5)
    quality = ranking.training_quality(ranking.response_ks(ranking.response_histograms(df))).first()
    assert quality["bad_ks"] == (quality["ks_pvalue_sig"] < 0.2 or quality["ks_pvalue_bkg"] < 0.2)


def scan(spark):
    rows = [
        ("a", 0.701, 0.9, 0.99, False),
        ("b", 0.704, 0.5, 0.96, False),
        ("c", 0.699, 0.95, 0.97, False),
        ("d", 0.703, 0.99, 0.90, False),
        ("e", 0.90, 0.05, 0.99, True),
        ("f", 0.60, 0.99, 0.99, False),
    ]
    return spark.createDataFrame(rows, "name string, auc double, ks_pvalue_sig double, ks_pvalue_bkg double, bad_ks boolean")


def test_best_scan_and_penalty(spark):
    assert [r["name"] for r in ml.select_best_scan(scan(spark)).collect()] == ["c", "a", "b"]
    assert [r["name"] for r in ml.select_best_scan(scan(spark), 1).collect()] == ["c"]
    penalized = {r["name"]: r["penalized"] for r in ml.penalized_score(scan(spark)).collect()}
    assert penalized["e"] == pytest.approx(0.81) and penalized["a"] == 0.701
    assert ml.best_penalized(scan(spark)).first()["name"] == "e"
