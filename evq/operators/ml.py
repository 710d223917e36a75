"""Boosted trees: training, cross-validation, scans, feature ranking and scoring.

Trees are grown by :mod:`evq.operators.boosting` and become MLlib models. Loops over fits
run on the driver over one persisted table (recomputed block by block if an executor is lost:
splits and folds are hashes of the row key, so a recomputation gives the same rows).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkContext, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq import config
from evq.functions.keys import in_fraction
from evq.functions.regions import by_name, train_axes
from evq.operators import boosting
from evq.operators.frames import selection_column
from evq.operators.ranking import (
    fold_summary,
    mean_roc,
    response_histograms,
    response_ks,
    training_quality,
    weighted_auc,
)
from evq.operators.sampling import kfold_assign, split_label
from evq.plans.session import drop_folder, shared_folder

# MLlib takes no missing values: they become a value below every real one, which a split can separate.
MISSING = -1e30
IGNORED_AXES = ("num_leaves", "reg_lambda")
#: Nodes of a model up to which its trees are evaluated on whole columns; MLlib scores larger ones.
FEW_NODES = 5000
SELECTOR_AXES = {"learning_rate": 0.1, "max_depth": 5, "min_child_samples": 20}


@contextmanager
def persisted(df: DataFrame):
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows evenly over the cluster, by hash of the row key. A selection leaves partitions of very unequal
    size; boosting passes over the table hundreds of times, so one shuffle beforehand pays."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)


def feature_columns(df: DataFrame, key: str | None = None) -> list[str]:
    """The features of a prepared table: every column but key, label, weight and split marks."""
    return [c for c in df.columns if c not in {key, "label", "weight", "split", "fold"}]


# --- one fit --------------------------------------------------------------------


def fit_classifier(
    train: DataFrame,
    features: Sequence[str],
    axes: Mapping[str, float] | None = None,
    rounds: int = 500,
    validation: Column | None = None,
    patience: int = 10,
    label: str = "label",
    weight: str = "weight",
    seed: int = config.RANDOM_STATE,
) -> PipelineModel:
    """Weighted boosted trees. Rows where ``validation`` is true are held back and their loss is taken after every
    round: the model ends at the best round found before ``patience`` rounds without gain.
    ``num_leaves`` and ``reg_lambda`` have no counterpart in MLlib and are ignored (:func:`ignored_axes`)."""
    axes = train_axes(**(axes or {}))
    with boosting.binned(train, features, validation, MISSING, label, weight) as rows:
        grown = _grown(rows, [features], axes, rounds, patience if validation is not None else None)[0]
    return _as_pipeline(train, features, axes, rounds, grown, rows.thresholds, label, weight, seed)


def _grown(rows: boosting.Binned, lists: Sequence[Sequence[str]], axes: Mapping[str, float], rounds: int, patience: int | None = None) -> list[list[boosting.Tree]]:
    """The trees of a fit per feature list, all from the same passes; with a ``patience`` only up to the best round."""
    fits = [boosting.Fit(f, int(rounds), float(axes["learning_rate"]), int(axes["max_depth"]), int(axes["min_child_samples"])) for f in lists]
    trees = boosting.grow(rows, fits)
    if patience is None:
        return trees
    return [t[: best_round(losses, patience)] for t, losses in zip(trees, boosting.losses(rows, trees))]


def _as_pipeline(
    train: DataFrame,
    features: Sequence[str],
    axes: Mapping[str, float],
    rounds: int,
    grown: Sequence[boosting.Tree],
    thresholds: Sequence[Sequence[float]],
    label: str = "label",
    weight: str = "weight",
    seed: int = config.RANDOM_STATE,
) -> PipelineModel:
    """Grown trees as an MLlib model: its transformers, persistence and importances."""
    settings = GBTClassifier(
        featuresCol="_features",
        labelCol=label,
        weightCol=weight,
        predictionCol="_prediction",
        maxIter=int(rounds),
        stepSize=float(axes["learning_rate"]),
        maxDepth=int(axes["max_depth"]),
        minInstancesPerNode=int(axes["min_child_samples"]),
        seed=seed,
    )
    settings = settings.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    settings._transfer_params_to_java()
    java = SparkContext._jvm.org.apache.spark.ml
    trees = [java.regression.DecisionTreeRegressionModel(_java_node(t, 0, thresholds), len(features)) for t in grown]
    model = _java_ensemble(settings._java_obj, trees, [t.weight for t in grown], len(features), 2)
    filled = ", ".join(f"coalesce(nanvl(`{f}`, CAST(NULL AS DOUBLE)), {MISSING}D) AS `_in_{f}`" for f in features)
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="_features")
    return Pipeline(stages=[fill, assemble, model]).fit(train)


def _java_node(tree: boosting.Tree, at: int, thresholds: Sequence[Sequence[float]]):
    jvm, gateway = SparkContext._jvm.org.apache.spark, SparkContext._gateway
    sums = gateway.new_array(SparkContext._jvm.double, 3)
    rows, *values = map(float, tree.stats[at])
    for i, value in enumerate(values):
        sums[i] = value
    stats = jvm.mllib.tree.impurity.VarianceCalculator(sums, int(rows))
    prediction, impurity = float(tree.values()[at]), float(boosting.impurity(tree.stats[at]))
    feature = tree.feature[at]
    if feature < 0:
        return jvm.ml.tree.LeafNode(prediction, impurity, stats)
    split = jvm.ml.tree.ContinuousSplit(feature, float(thresholds[feature][tree.cut[at]]))
    left, right = (_java_node(tree, tree.left[at] + side, thresholds) for side in (0, 1))
    return jvm.ml.tree.InternalNode(prediction, impurity, tree.gain[at], left, right, split, stats)


def _java_ensemble(like, trees: Sequence, weights: Sequence[float], features: int, classes: int) -> GBTClassificationModel:
    """An MLlib model of these trees with the settings of ``like``."""
    gateway, java = SparkContext._gateway, SparkContext._jvm.org.apache.spark.ml
    every = gateway.new_array(java.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(SparkContext._jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        every[i], shares[i] = tree, float(weight)
    made = java.classification.GBTClassificationModel(like.uid(), every, shares, features, classes)
    model = GBTClassificationModel(like.copyValues(made, java.param.ParamMap()))
    model._transfer_params_from_java()
    return model


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model of the first ``rounds`` trees and their weights: what a fit of so many rounds gives, without fitting."""
    whole = _trees(model)
    if rounds >= whole.getNumTrees:
        return model
    jvm = whole._java_obj
    last = _java_ensemble(jvm, jvm.trees()[:rounds], whole.treeWeights[:rounds], jvm.numFeatures(), jvm.numClasses())
    return PipelineModel([*model.stages[:-1], last])


def best_round(losses: Sequence[float], patience: int) -> int:
    """The number of rounds with the least loss, looking no further than ``patience`` rounds without gain; all
    rounds where no loss is known (no validation rows)."""
    best, least = len(losses), float("inf")
    for number, loss in enumerate(losses, 1):
        if loss < least:
            best, least = number, loss
        elif least < float("inf") and number - best >= patience:
            break
    return best


def ignored_axes(axes: Mapping[str, float]) -> list[str]:
    return [a for a in IGNORED_AXES if a in axes]


def _trees(model: PipelineModel):
    return model.stages[-1]


def _features(model: PipelineModel) -> list[str]:
    return [c.removeprefix("_in_") for c in model.stages[-2].getInputCols()]


def best_iteration(model: PipelineModel) -> int:
    return _trees(model).getNumTrees


def with_score(df: DataFrame, model: PipelineModel, name: str = "score", raw: bool = False) -> DataFrame:
    """Add P(signal), or the raw response, of a model (the column keeps its place if it exists)."""
    return _with_scores(df, {name: model}, raw=raw)


def _with_scores(
    df: DataFrame, models: Mapping[str, PipelineModel], where: Column | None = None, raw: bool = False
) -> DataFrame:
    """Add one score per model, null where ``where`` is not true.

    The condition wraps each score as it is made, so the trees are evaluated
    only for rows that pass it; models of the same features share one assembly.
    """
    keep = [c for c in df.columns if c not in models]
    if where is not None:
        df = df.withColumn("_where", where)
        keep = [*keep, "_where"]
    assembled = None
    for name, model in models.items():
        features = _features(model)
        inputs = [f"_in_{f}" for f in features]
        if features != assembled:
            df = df.select(*keep)
            for stage in model.stages[:-1]:
                df = stage.transform(df)
            assembled = features
        trees = _small_trees(model)
        if trees is not None:
            score = _tree_scores(trees, raw)(F.lit(True) if where is None else F.col("_where"), *inputs)
        else:
            df = _trees(model).transform(df)
            score = vector_to_array("_raw" if raw else "_probability")[1]
            if where is not None:
                score = F.when(F.col("_where"), score)
        df = df.select(*keep, "_features", *inputs, score.alias(name))
        keep.append(name)
    return df.select(*[c for c in keep if c != "_where"])


def _small_trees(model: PipelineModel) -> list[boosting.Tree] | None:
    """A model's trees with the thresholds themselves as cuts, if there are not too many nodes to fetch one by one and
    no categorical splits."""
    if _trees(model).totalNumNodes > FEW_NODES:
        return None
    found = []
    for tree, weight in zip(_trees(model)._java_obj.trees(), _trees(model).treeWeights):
        grown = boosting.Tree(float(weight))
        todo = [tree.rootNode()]
        grown.feature, grown.cut, grown.left, grown.gain, grown.stats, grown.depth = [], [], [], [], [], tree.depth()
        for node in todo:  # children are added behind, so every node gets its place in this order
            inner = node.getClass().getSimpleName() == "InternalNode"
            if inner and node.split().getClass().getSimpleName() != "ContinuousSplit":
                return None
            grown.feature.append(node.split().featureIndex() if inner else -1)
            grown.cut.append(node.split().threshold() if inner else 0.0)
            grown.left.append(len(todo) if inner else 0)
            grown.stats.append(np.array([0.0, 1.0, node.prediction(), 0.0]))
            if inner:
                todo += [node.leftChild(), node.rightChild()]
        found.append(grown)
    return found


def _tree_scores(trees: Sequence[boosting.Tree], raw: bool):
    """P(signal), or the raw response, of the rows that pass, from whole columns at a time; null for the others."""

    @F.arrow_udf("double")
    def score(passes: pa.Array, *columns: pa.Array) -> pa.Array:
        passed = pa.compute.fill_null(passes, False).to_numpy(zero_copy_only=False)
        x = np.stack([c.to_numpy(zero_copy_only=False)[passed] for c in columns])
        total = np.zeros(x.shape[1])
        for tree in trees:
            total += tree.weight * tree.values()[tree.follow(x)]
        result = np.zeros(len(passed))
        result[passed] = total if raw else 1.0 / (1.0 + np.exp(-2.0 * total))
        return pa.array(result, mask=~passed)

    return score


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """``feature, gain, split`` of a model: each normalised to a sum of 1 and rounded to 4, most gain first."""
    gain, split = importances(model)
    rows = [(f, round(gain[f], 4), round(split[f], 4)) for f in _features(model)]
    return spark.createDataFrame(rows, "feature string, gain double, split double").orderBy(
        F.col("gain").desc(), F.col("feature").desc()
    )


def importances(model: PipelineModel) -> tuple[dict[str, float], dict[str, float]]:
    """Gain and split-count importances of a model, one number per feature, each with a sum of 1."""
    return gain_importances(model), split_importances(model)


def gain_importances(model: PipelineModel) -> dict[str, float]:
    gain = _trees(model).featureImportances.toArray()
    total = gain.sum() or 1.0
    return {name: float(gain[i] / total) for i, name in enumerate(_features(model))}


def split_importances(model: PipelineModel) -> dict[str, float]:
    """The share of all splits, numerical and categorical, that are on each feature."""
    spark = SparkSession.getActiveSession()
    folder = shared_folder(spark, "model")
    try:
        splits = node_table(model, folder).filter("left IS NOT NULL").groupBy("feature").count().collect()  # a row per feature
    finally:
        drop_folder(spark, folder)
    total = sum(r["count"] for r in splits) or 1
    counts = {r["feature"]: r["count"] for r in splits}
    return {name: counts.get(name, 0) / total for name in _features(model)}


def node_table(model: PipelineModel, folder: str) -> DataFrame:
    """One row per node of a model's trees, read from its saved form in ``folder``: ``tree, node, prediction, rows,
    gain, left, right, feature, threshold, categories``. A leaf has no children, feature and gain; a split on a
    categorical feature has the categories that go left, another one its threshold."""
    trees = _trees(model)
    trees.write().overwrite().save(folder)
    nodes = SparkSession.getActiveSession().read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner, names = F.col("leftChild") >= 0, F.array(*map(F.lit, _features(model)))
    categorical = F.col("split.numCategories") >= 0
    bounds = F.col("split.leftCategoriesOrThreshold")
    return nodes.select(
        "tree",
        F.col("id").alias("node"),
        "prediction",
        F.col("rawCount").alias("rows"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.element_at(names, F.col("split.featureIndex") + 1)).alias("feature"),
        F.when(inner & ~categorical, bounds[0]).alias("threshold"),
        F.when(inner & categorical, bounds).alias("categories"),
    )


# --- one training ---------------------------------------------------------------


def single_training(
    df: DataFrame,
    key: str,
    features: Sequence[str] | None = None,
    axes: Mapping[str, float] | None = None,
    rounds: int = 500,
    early_stop: bool = True,
    test_size: float = 0.4,
    selection: str = "",
    extra: Mapping | None = None,
    nbins: int = 30,
) -> tuple[PipelineModel, DataFrame]:
    """Split, fit, and judge on the test rows: the model and a one-row summary table."""
    features = list(features or feature_columns(df, key))
    with _split_and_binned(df, key, features, test_size, early_stop) as split:
        return _train_and_judge(split, key, features, axes, rounds, early_stop, selection, extra, nbins)


class _Split(NamedTuple):
    """A persisted table with its ``split``, and its training rows in bins, for any number of fits."""

    table: DataFrame
    rows: boosting.Binned


@contextmanager
def _split_and_binned(df: DataFrame, key: str, features: Sequence[str], test_size: float, early_stop: bool = True):
    validation = in_fraction(key, 0.2, f"{config.RANDOM_STATE}:valid") if early_stop else None
    with persisted(_split_once(df, key, features, test_size)) as table, boosting.binned(table.filter("split = 'train'"), features, validation, MISSING) as rows:
        yield _Split(table, rows)


def _split_once(df: DataFrame, key: str, features: Sequence[str], test_size: float) -> DataFrame:
    table = df.select(key, *features, "label", "weight", split_label(key, test_size).alias("split"))
    return spread(table, key)


def _train_and_judge(
    split: _Split,
    key: str,
    features: Sequence[str],
    axes: Mapping[str, float] | None,
    rounds: int,
    early_stop: bool = True,
    selection: str = "",
    extra: Mapping | None = None,
    nbins: int = 30,
) -> tuple[PipelineModel, DataFrame]:
    """The training on a table that already has its ``split`` and bins."""
    table, binned = split
    spark = table.sparkSession
    axes = train_axes(**(axes or {}))
    grown = _grown(binned, [features], axes, rounds, 10 if early_stop else None)[0]
    model = _as_pipeline(table, features, axes, rounds, grown, binned.thresholds)
    with persisted(with_score(table, model).select("label", "weight", "split", "score")) as scored:
        shapes = response_histograms(scored, nbins=nbins)
        # At most four histograms of nbins rows: the tests run on the finished shapes, not on the events again.
        curves = [tuple(r) for r in shapes.orderBy("split", "label", "bin").collect()]
        shapes = spark.createDataFrame(curves, shapes.schema)
        tests = training_quality(response_ks(shapes)).first().asDict()
        aucs = {r["split"]: r["auc"] for r in weighted_auc(scored, by=["split"]).collect()}
    gain, split = importances(model)
    row = {
        **tests,
        "auc": aucs.get("test"),
        "auc_train": aucs.get("train"),
        "selection_used": selection,
        "features": list(features),
        "set_params": {k: float(v) for k, v in axes.items()},
        "ignored_params": ignored_axes(axes),
        "best_iteration": best_iteration(model) if early_stop else -1,
        "importances_gain": gain,
        "importances_split": split,
        "response_histograms": curves,
        "extra": {k: str(v) for k, v in (extra or {}).items()},
    }
    return model, spark.createDataFrame([tuple(row[f] for f in SUMMARY_FIELDS)], SUMMARY_SCHEMA)


SUMMARY_SCHEMA = (
    "auc double, auc_train double, ks_test_sig double, ks_pvalue_sig double, ks_test_bkg double, "
    "ks_pvalue_bkg double, bad_ks boolean, selection_used string, features array<string>, "
    "set_params map<string,double>, ignored_params array<string>, best_iteration int, "
    "importances_gain map<string,double>, importances_split map<string,double>, "
    "response_histograms array<struct<split:string,label:int,bin:int,lo:double,hi:double,count:double,err:double>>, "
    "extra map<string,string>"
)
SUMMARY_FIELDS = [part.split()[0] for part in re.split(r", (?=\w+ )", SUMMARY_SCHEMA)]


def save_training(model: PipelineModel, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    root = path.rstrip("/")
    model.save(f"{root}/model")
    summary.coalesce(1).write.mode(mode).json(f"{root}/summary")


def load_training(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    root = path.rstrip("/")
    summary = spark.read.schema(SUMMARY_SCHEMA).json(f"{root}/summary").first()
    return PipelineModel.load(f"{root}/model"), summary.asDict()


# --- cross-validation -----------------------------------------------------------


def folded_training(
    df: DataFrame,
    key: str,
    features: Sequence[str] | None = None,
    axes: Mapping[str, float] | None = None,
    rounds: int = 500,
    k: int = 3,
    points: int = 100,
) -> tuple[list[PipelineModel], DataFrame, DataFrame, DataFrame]:
    """k-fold training. Returns the models, the one-row :func:`fold_summary`, the mean ROC curve and the
    averaged, normalised importances. Each fold is scored by the model that did not see it."""
    spark = df.sparkSession
    features = list(features or feature_columns(df, key))
    with persisted(spread(kfold_assign(df.select(key, *features, "label", "weight"), key, k), key)) as table:
        models = [fit_classifier(table.filter(F.col("fold") != i), features, axes, rounds) for i in range(k)]
        held_out = [
            with_score(table.filter(F.col("fold") == i), m).select("label", "weight", "fold", "score")
            for i, m in enumerate(models)
        ]
        scored = held_out[0]
        for part in held_out[1:]:
            scored = scored.unionByName(part)
        with persisted(scored) as scored:
            summary = [tuple(fold_summary(scored, points=points).first())]
            curve = [tuple(r) for r in mean_roc(scored, points=points).collect()]
    shares = [gain_importances(m) for m in models]
    mean = {f: sum(s[f] for s in shares) / k for f in features}
    total = sum(mean.values()) or 1.0
    return (
        models,
        spark.createDataFrame(summary, "auc double, auc_std double, score double, folds int"),
        spark.createDataFrame(curve, "point int, fpr double, tpr double"),
        spark.createDataFrame([(f, v / total) for f, v in mean.items()], "feature string, importance double"),
    )


# --- scans ----------------------------------------------------------------------


def grid_points(grid: Mapping[str, Sequence] | None = None) -> list[dict]:
    """Distinct points of a parameter grid once the axes MLlib does not have are dropped."""
    grid = {a: v for a, v in (grid or config.SCAN_GRID).items() if a not in IGNORED_AXES}
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def parameter_scan(
    df: DataFrame,
    key: str,
    features: Sequence[str] | None = None,
    grid: Mapping[str, Sequence] | None = None,
    rounds: int = 500,
    test_size: float = 0.4,
    parallelism: int = 4,
    results: str | None = None,
) -> DataFrame:
    """One training per grid point, a few at a time so that the cluster stays busy between the small jobs of
    a boosting round: ``name, auc, ks..., bad_ks, best_iteration`` and the parameters as JSON.

    With a ``results`` folder each point is kept there once done, below a fingerprint of the data, the features and
    the settings, and a scan that is started again trains only what is missing. Another table, other features, rounds
    or another split have another fingerprint, so results of different scans never mix."""
    spark = df.sparkSession
    features = list(features or feature_columns(df, key))
    points = {"_".join(f"{a}-{v}" for a, v in point.items()): point for point in grid_points(grid)}
    with _split_and_binned(df, key, features, test_size) as split:
        folder, done = None, {}
        if results is not None:
            folder = _scan_folder(split.table, results, {"key": key, "features": features, "rounds": rounds, "test_size": test_size, "seed": config.RANDOM_STATE})
            done = _kept_points(spark, folder)
        missing = [name for name in points if name not in done]

        def train(name: str) -> tuple:
            r = _train_and_judge(split, key, features, points[name], rounds)[1].first()
            row = (name, *(r[c] for c in _SCAN_FIELDS[1:-1]), json.dumps(points[name]))
            if folder is not None:
                spark.createDataFrame([row], SCAN_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/points/{name}")
            return row

        with ThreadPoolExecutor(parallelism) as pool:
            done |= dict(zip(missing, pool.map(train, missing)))
    return spark.createDataFrame([done[name] for name in points], SCAN_SCHEMA)


def _scan_folder(table: DataFrame, results: str, settings: Mapping) -> str:
    """Where the points of a scan of this table with these settings are kept; beside them, once, the settings as JSON."""
    about = json.dumps({**settings, "data": table_fingerprint(table)}, sort_keys=True)
    folder = f"{results.rstrip('/')}/scan-{hashlib.sha256(about.encode()).hexdigest()[:16]}"
    table.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")
    return folder


def table_fingerprint(df: DataFrame) -> str:
    """Number of rows and two sums of their hashes: the same for the same rows in any order and partitioning."""
    columns = by_name(df.columns)
    row = F.xxhash64(*columns)
    halves = [F.sum(half.cast("decimal(20,0)")) for half in (F.shiftrightunsigned(row, 32), row.bitwiseAND(F.lit(0xFFFFFFFF)))]
    found = df.agg(F.count(F.lit(1)), *[F.coalesce(half, F.lit(0)) for half in halves]).first()
    return "-".join([*columns, *map(str, found)])


SCAN_SCHEMA = (
    "name string, auc double, ks_test_sig double, ks_pvalue_sig double, ks_test_bkg double, "
    "ks_pvalue_bkg double, bad_ks boolean, best_iteration int, params string"
)
_SCAN_FIELDS = [part.split()[0] for part in SCAN_SCHEMA.split(", ")]


def _kept_points(spark: SparkSession, folder: str) -> dict[str, tuple]:
    try:
        rows = spark.read.schema(SCAN_SCHEMA).json(f"{folder}/points/*").collect()
    except AnalysisException:  # nothing kept yet
        return {}
    return {r["name"]: tuple(r) for r in rows}


def select_best_scan(results: DataFrame, n: int = 16) -> DataFrame:
    """Scan results whose AUC rounds to the best one and whose background shapes agree, by signal agreement."""
    good = results.filter(~F.col("bad_ks"))
    best = good.agg(F.bround(F.max("auc"), 2)).scalar()
    return (
        good.filter((F.bround("auc", 2) == best) & (F.col("ks_pvalue_bkg") > 0.95))
        .orderBy(F.col("ks_pvalue_sig").desc(), F.col("name"))
        .limit(n)
    )


def penalized_score(results: DataFrame) -> DataFrame:
    """Add ``penalized``: the AUC, cut by a tenth where train and test shapes disagree."""
    poor = (F.col("ks_pvalue_sig") < 0.1) | (F.col("ks_pvalue_bkg") < 0.1)
    return results.withColumn("penalized", F.when(poor, F.col("auc") * 0.9).otherwise(F.col("auc")))


def best_penalized(results: DataFrame) -> DataFrame:
    """The result with the highest penalised score (first by name among equals)."""
    return penalized_score(results).orderBy(F.col("penalized").desc(), F.col("name")).limit(1)


# --- scoring --------------------------------------------------------------------


def apply_single(
    df: DataFrame,
    model: PipelineModel,
    name: str = "response",
    selection: str | None = None,
) -> DataFrame:
    """Score events; with a ``selection`` only those passing it, the others keep the column's value (-9999)."""
    return apply_folded(df, [model], name, selection)


def apply_folded(
    df: DataFrame,
    models: Sequence[PipelineModel],
    name: str = "response",
    selection: str | None = None,
) -> DataFrame:
    """Score events with the mean of the fold models."""
    scored = df if name in df.columns else df.withColumn(name, F.lit(config.UNSCORED))
    marks = {f"_score{i}": model for i, model in enumerate(models)}
    where = selection_column(scored, selection) if selection is not None else None
    mean = sum((F.col(m) for m in list(marks)[1:]), F.col("_score0")) / F.lit(float(len(marks)))
    scored = _with_scores(scored, marks, where)
    return scored.withColumn(name, F.coalesce(mean, F.col(name))).drop(*marks)


def combine_scores(df: DataFrame, scores: Sequence[tuple[str, str]], name: str = "response") -> DataFrame:
    """Response from score columns, ``(selection, score column)`` in order: a later match overwrites."""
    response = F.lit(config.UNSCORED)
    for selection, column in scores:
        response = F.when(selection_column(df, selection), F.col(column)).otherwise(response)
    return df.withColumn(name, response)


def apply_all(
    df: DataFrame, key: str, trainings: Sequence[tuple[Sequence[PipelineModel], str]], name: str = "response"
) -> DataFrame:
    """``key, response`` of every event under several region trainings ``(models, selection)`` in order."""
    for models, selection in trainings:
        df = apply_folded(df, models, name, selection)
    if name not in df.columns:
        df = df.withColumn(name, F.lit(config.UNSCORED))
    return df.select(key, name)


# --- ranking features by fits ---------------------------------------------------


def _aucs_of_fits(
    df: DataFrame, key: str, candidates: Sequence[str], lists: Sequence[Sequence[str]], axes: Mapping[str, float], rounds: int, test_size: float
) -> list[float]:
    """AUC on the test rows of a fit per feature list that stops early on them. The rows are binned once for all fits,
    which grow and are judged in the same passes."""
    with persisted(_split_once(df, key, candidates, test_size).drop(key)) as table, boosting.binned(table, candidates, F.col("split") == "test", MISSING) as rows:
        table.unpersist()  # the bins hold all that is needed
        grown = _grown(rows, lists, train_axes(**axes), rounds, patience=10)
        aucs = {r["fit"]: r["auc"] for r in weighted_auc(boosting.score_weights(rows, grown), by=["fit"]).collect()}
    return [aucs.get(i) for i in range(len(lists))]


def feature_importances_repeated(
    df: DataFrame,
    key: str,
    features: Sequence[str] | None = None,
    axes: Mapping[str, float] | None = None,
    rounds: int = 200,
    n_fits: int = 5,
    test_size: float = 0.5,
) -> DataFrame:
    """``feature, importance``: mean gain over fits on ``n_fits`` different halves, highest first."""
    features = list(features or feature_columns(df, key))
    rows = []
    with persisted(spread(df.select(key, *features, "label", "weight"), key)) as table:
        for i in range(1, n_fits + 1):
            validation = in_fraction(key, test_size, i * config.RANDOM_STATE)
            model = fit_classifier(table, features, axes or SELECTOR_AXES, rounds, validation)
            rows += [(i, f, g) for f, g in gain_importances(model).items()]
    return (
        df.sparkSession.createDataFrame(rows, "fit int, feature string, gain double")
        .groupBy("feature")
        .agg(F.avg("gain").alias("importance"))
        .orderBy(F.col("importance").desc(), F.col("feature"))
    )


def iterative_remove_auc(
    df: DataFrame,
    key: str,
    candidates: Sequence[str],
    axes: Mapping[str, float] | None = None,
    rounds: int = 200,
    test_size: float = 0.33,
    max_features: int | None = None,
) -> DataFrame:
    """``feature, auc``: the AUC without each candidate, lowest (most missed) first."""
    candidates = list(candidates)[:max_features]
    lists = [[f for f in candidates if f != c] for c in candidates]
    aucs = _aucs_of_fits(df, key, candidates, lists, axes or SELECTOR_AXES, rounds, test_size)
    return df.sparkSession.createDataFrame([*zip(candidates, aucs)], "feature string, auc double").orderBy("auc", "feature")


def iterative_add_auc(
    df: DataFrame,
    key: str,
    candidates: Sequence[str],
    axes: Mapping[str, float] | None = None,
    rounds: int = 200,
    test_size: float = 0.33,
    max_features: int | None = None,
) -> DataFrame:
    """``n, feature, auc``: the AUC with the first 1, 2, ... candidates."""
    candidates = list(candidates)[:max_features]
    numbers = range(1, len(candidates) + 1)
    aucs = _aucs_of_fits(df, key, candidates, [candidates[:n] for n in numbers], axes or SELECTOR_AXES, rounds, test_size)
    rows = [*zip(numbers, candidates, aucs)]
    return df.sparkSession.createDataFrame(rows, "n int, feature string, auc double")
