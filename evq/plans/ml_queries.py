"""Queries that train boosted trees, over all rows of the table.

A tree is not SQL, but what must hold of it is: which events are scored, that scores are probabilities, that
folds are averaged, which features and points come back, that summaries agree with their parts. Each query gives
those facts as columns, computed from the operator's full values; one stump is compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq import config
from evq.functions.regions import features_for
from evq.operators import frames, ml, prep
from evq.operators.ranking import weighted_auc
from evq.operators.sampling import kfold_assign, split_label
from evq.plans.catalog import query, rounded, unit_sql
from evq.plans.views import EVENT_SQL, events, wide_events

KEY = "event_id"
FEATURES = features_for("2j2b")
AXES = {"learning_rate": 0.2, "max_depth": 3, "min_child_samples": 50}
#: Boosting rounds of every fit below: a parameter of the queries, not of the operators (500 by default).
ROUNDS = 5
EV = f"WITH ev AS ({EVENT_SQL})"


def _prepared(spark, sf, condition: str = "true"):
    df = wide_events(spark, sf).filter(condition).select(KEY, *FEATURES, "label", frames.clipped("weight_nominal").alias("weight"))
    return prep.normalize_mean_weight(prep.scale_sum_weights(df))


def _model(spark, sf, condition: str = "true"):
    """A model of the training rows; the boosting passes over its input several times, hence the cache."""
    with ml.persisted(ml.spread(_prepared(spark, sf, condition), KEY)) as table:
        return ml.fit_classifier(table.filter(split_label(KEY, 0.4) == "train"), FEATURES, AXES, ROUNDS)


def _share(column: str, name: str):
    return ((F.col(column) >= 0) & (F.col(column) <= 1)).alias(name)


def _facts(result: DataFrame) -> DataFrame:
    """A small result with each row's position: operators that rank return their rows in order."""
    rows = result.collect()
    schema = result.schema.add("position", "integer")
    return result.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


# --- values: boosting restated in SQL ---------------------------------------------
#
# Trees of depth one on a feature of two values have one leaf per value, whose values are known in closed form: the
# weighted mean of the targets (-1 and 1), then, times the learning rate, that of 4 y / (1 + exp(2 y F)) for the
# response F so far. A score of two values has an AUC of 1/2 + (a - b) / 2, where a and b are the shares of signal
# and background that have the higher one.

STUMP = {"max_depth": 1, "min_child_samples": 1, "learning_rate": 0.1}


def _two_valued(spark, sf):
    flag = F.col("OS").cast("double").alias("OS")
    return events(spark, sf).select(KEY, flag, "const_feature", "label", frames.clipped("weight_nominal").alias("weight"))


_W = f"{EV}, w AS (SELECT event_id, OS, label, CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS weight FROM ev)"


def _boosted_sql(rows: str, by: str = "") -> str:
    """``f`` per value of OS (and ``by``): the response after two rounds on ``rows``."""
    key = f"{by}, OS" if by else "OS"
    return f"""(SELECT {key}, f + {STUMP["learning_rate"]}::DOUBLE * sum(weight * 4.0::DOUBLE * (2 * label - 1) / (1.0::DOUBLE + exp(2.0::DOUBLE * (2 * label - 1) * f))) / sum(weight) AS f
      FROM (SELECT *, sum(weight * (2 * label - 1)::DOUBLE) OVER (PARTITION BY {key}) / sum(weight) OVER (PARTITION BY {key}) AS f FROM {rows}) GROUP BY {key}, f)"""


def _auc_sql(rows: str, leaves: str, by: str = "") -> str:
    """``auc`` (per ``by``) of ``rows`` scored by ``leaves``."""
    key = f"{by}, " if by else ""
    join = f"JOIN {leaves} USING ({key}OS) JOIN (SELECT {key}max(f) AS top FROM {leaves} GROUP BY ALL) {f'USING ({by})' if by else 'ON true'}"
    high = "sum(CASE WHEN label = {} AND f = top THEN weight ELSE 0 END)::DOUBLE / sum(CASE WHEN label = {} THEN weight ELSE 0 END)"
    return f"SELECT {key}0.5::DOUBLE + 0.5::DOUBLE * ({high.format(1, 1)} - {high.format(0, 0)}) AS auc FROM {rows} {join} GROUP BY ALL"


_SPLIT_SQL = f"CASE WHEN {unit_sql()} < {{}} THEN 'test' ELSE 'train' END AS split"


def _share_of(size: float) -> int:
    return int(round(size * 2**32))


@query(
    "fit_classifier_boosted",
    f"{_W}, leaf AS {_boosted_sql('w')} SELECT event_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-2.0::DOUBLE * f)), 6) AS score FROM ev JOIN leaf USING (OS)",
)
def _(spark, sf):
    table = _two_valued(spark, sf)
    return rounded(ml.with_score(table, ml.fit_classifier(table, ["OS"], STUMP, 2)).select(KEY, "score"), 6, "score")


@query(
    "single_training_boosted",
    f"""{_W}, s AS (SELECT *, {_SPLIT_SQL.format(_share_of(0.4))} FROM w), t AS (SELECT * FROM s WHERE split = 'train'), leaf AS {_boosted_sql('t')},
    every AS (SELECT split, OS, f FROM leaf, (SELECT DISTINCT split FROM s)), a AS ({_auc_sql('s', 'every', 'split')})
    SELECT round(max(auc) FILTER (split = 'test'), 6) AS auc, round(max(auc) FILTER (split = 'train'), 6) AS auc_train, -1 AS best_iteration,
      1.0::DOUBLE AS gain_os, 0.0::DOUBLE AS gain_const, 1.0::DOUBLE AS split_os, 0.0::DOUBLE AS split_const FROM a""",
)
def _(spark, sf):
    _, summary = ml.single_training(_two_valued(spark, sf), KEY, ["OS", "const_feature"], STUMP, 2, early_stop=False)
    named = {f"{short}_{tail}": F.col(f"importances_{short}")[name] for short in ("gain", "split") for tail, name in (("os", "OS"), ("const", "const_feature"))}
    return rounded(summary.select("auc", "auc_train", "best_iteration", *[c.alias(n) for n, c in named.items()]), 6, "auc", "auc_train")


@query(
    "folded_training_boosted",
    f"""{_W}, k AS (SELECT *, {unit_sql()} % 3 AS fold FROM w), t AS (SELECT i AS left_out, k.* EXCLUDE (fold) FROM k, range(3) r(i) WHERE fold <> i),
    leaf AS {_boosted_sql('t', 'left_out')}, held AS (SELECT fold AS left_out, * EXCLUDE (fold) FROM k), a AS ({_auc_sql('held', 'leaf', 'left_out')})
    SELECT round(-avg(auc), 6) AS score, round(stddev_pop(auc), 6) AS auc_std, 3 AS folds, 1.0::DOUBLE AS importance_os FROM a""",
)
def _(spark, sf):
    _, summary, _, importance = ml.folded_training(_two_valued(spark, sf), KEY, ["OS", "const_feature"], STUMP, 2)
    share = importance.filter("feature = 'OS'").agg(F.max("importance")).scalar()
    return rounded(summary.select("score", "auc_std", "folds", share.alias("importance_os")), 6, "score", "auc_std")


@query("feature_importances_boosted", "SELECT 'OS' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'const_feature', 0.0::DOUBLE")
def _(spark, sf):
    return ml.feature_importances_repeated(_two_valued(spark, sf), KEY, ["const_feature", "OS"], STUMP, 2, n_fits=2)


_THIRD = f"""{_W}, s AS (SELECT *, {_SPLIT_SQL.format(_share_of(0.33))} FROM w), train AS (SELECT * FROM s WHERE split = 'train'),
    test AS (SELECT * FROM s WHERE split = 'test'), leaf AS {_boosted_sql('train')}, a AS ({_auc_sql('test', 'leaf')})"""


@query("iterative_remove_auc_boosted", f"{_THIRD} SELECT 'OS' AS feature, 0.5::DOUBLE AS auc UNION ALL SELECT 'const_feature', round(auc, 6) FROM a")
def _(spark, sf):
    return rounded(ml.iterative_remove_auc(_two_valued(spark, sf), KEY, ["const_feature", "OS"], STUMP, 2), 6, "auc")


@query("iterative_add_auc_boosted", f"{_THIRD} SELECT 1 AS n, 'const_feature' AS feature, 0.5::DOUBLE AS auc UNION ALL SELECT 2, 'OS', round(auc, 6) FROM a")
def _(spark, sf):
    return rounded(ml.iterative_add_auc(_two_valued(spark, sf), KEY, ["const_feature", "OS"], STUMP, 2), 6, "auc")


# --- trainings on the features of a region -----------------------------------------


@query("fit_classifier", f"{EV} SELECT event_id, label, true AS is_probability FROM ev")
def _(spark, sf):
    scored = ml.with_score(_prepared(spark, sf), _model(spark, sf))
    return scored.select(KEY, "label", ((F.col("score") > 0) & (F.col("score") < 1)).alias("is_probability"))


@query(
    "fit_classifier_stump",
    f"""{EV}, w AS (SELECT *, CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS weight FROM ev),
    leaf AS (SELECT OS, sum(weight * (2 * label - 1)) / sum(weight) AS m FROM w GROUP BY OS)
    SELECT event_id, round(1 / (1 + exp(-2 * m)), 6) AS score FROM ev JOIN leaf USING (OS)""",
)
def _(spark, sf):
    # One round of depth one on a feature of two values: the leaves are the weighted means of the two.
    table = _two_valued(spark, sf)
    model = ml.fit_classifier(table, ["OS"], STUMP, 1)
    return rounded(ml.with_score(table, model).select(KEY, "score"), 6, "score")


_FEATURE_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in FEATURES)


@query("feature_importance", f"SELECT feature, true AS is_share, true AS sums_to_one, true AS in_order FROM ({_FEATURE_ROWS})")
def _(spark, sf):
    ranked = _facts(ml.feature_importance(_model(spark, sf), spark))
    total = ranked.agg(F.sum("gain").alias("g"), F.sum("split").alias("s")).first()
    gains = [r["gain"] for r in ranked.orderBy("position").collect()]
    sums = abs(total["g"] - 1) < 1e-3 and abs(total["s"] - 1) < 1e-3
    return ranked.select("feature", _share("gain", "is_share"), F.lit(sums).alias("sums_to_one"), F.lit(gains == sorted(gains, reverse=True)).alias("in_order"))


@query(
    "single_training",
    f"SELECT true AS auc_is_share, true AS auc_train_is_share, true AS bad_ks_agrees, true AS iteration_in_range, {len(FEATURES)} AS features, 'true' AS selection_used",
)
def _(spark, sf):
    _, summary = ml.single_training(_prepared(spark, sf), KEY, FEATURES, AXES, ROUNDS, selection="true")
    poor = (F.col("ks_pvalue_sig") < 0.2) | (F.col("ks_pvalue_bkg") < 0.2)
    return summary.select(
        _share("auc", "auc_is_share"),
        _share("auc_train", "auc_train_is_share"),
        (F.col("bad_ks") == poor).alias("bad_ks_agrees"),
        F.col("best_iteration").between(1, ROUNDS).alias("iteration_in_range"),
        F.size("features").alias("features"),
        "selection_used",
    )


@query("folded_training", "SELECT 3 AS folds, true AS auc_is_share, true AS score_is_mean, true AS importance_sums_to_one")
def _(spark, sf):
    table = _prepared(spark, sf)
    models, summary, _, importance = ml.folded_training(table, KEY, FEATURES, AXES, ROUNDS)
    held = kfold_assign(table, KEY, len(models))
    aucs = [weighted_auc(ml.with_score(held.filter(F.col("fold") == i), m)).first()["auc"] for i, m in enumerate(models)]
    total = importance.agg(F.sum("importance")).first()[0]
    return summary.select(
        "folds",
        _share("auc", "auc_is_share"),
        (F.abs(F.col("score") + sum(aucs) / len(aucs)) < 1e-9).alias("score_is_mean"),
        F.lit(abs(total - 1) < 1e-9).alias("importance_sums_to_one"),
    )


_GRID = {"max_depth": [2, 3], "learning_rate": [0.1, 0.2], "num_leaves": [8, 16], "min_child_samples": [100]}
_POINTS = [(d, r) for d in _GRID["max_depth"] for r in _GRID["learning_rate"]]


@query(
    "parameter_scan",
    " UNION ALL ".join(
        f"""SELECT 'max_depth-{d}_learning_rate-{r}_min_child_samples-100' AS name,
        '{{"max_depth": {d}, "learning_rate": {r}, "min_child_samples": 100}}' AS params, true AS auc_is_share, true AS iteration_in_range"""
        for d, r in _POINTS
    ),
)
def _(spark, sf):
    scan = ml.parameter_scan(_prepared(spark, sf), KEY, FEATURES, _GRID, ROUNDS)
    return scan.select("name", "params", _share("auc", "auc_is_share"), F.col("best_iteration").between(1, ROUNDS).alias("iteration_in_range"))


def _scored(response: str = "response"):
    there = F.col(response) != config.UNSCORED
    return there.alias("scored"), (~there | F.col(response).between(0, 1)).alias("in_range")


@query("apply_single", f"{EV} SELECT event_id, reg2j2b AND OS = 1 AS scored, true AS in_range FROM ev")
def _(spark, sf):
    scored = ml.apply_single(wide_events(spark, sf), _model(spark, sf), selection="(reg2j2b == True) & (OS == True)")
    return scored.select(KEY, *_scored())


@query("apply_folded", f"{EV} SELECT event_id, OS = 1 AND mass_lep1jet1 < 155 AS scored, true AS in_range, true AS is_mean FROM ev")
def _(spark, sf):
    models, _, _, _ = ml.folded_training(_prepared(spark, sf), KEY, FEATURES, AXES, ROUNDS)
    scored = ml.apply_folded(wide_events(spark, sf), models, selection="OS == 1 && mass_lep1jet1 < 155")
    for i, model in enumerate(models):
        scored = ml.with_score(scored, model, f"one{i}")
    mean = sum(F.col(f"one{i}") for i in range(len(models))) / len(models)
    same = (F.col("response") == config.UNSCORED) | (F.abs(F.col("response") - mean) < 1e-9)
    return scored.select(KEY, *_scored(), same.alias("is_mean"))


@query("apply_all", f"{EV} SELECT event_id, OS = 1 AND (reg1j1b OR reg2j2b) AS scored, true AS in_range, true AS of_own_region FROM ev")
def _(spark, sf):
    regions = ["OS = 1 AND reg1j1b", "OS = 1 AND reg2j2b"]
    models = [_model(spark, sf, region) for region in regions]
    trainings = [([models[0]], "OS == 1 && reg1j1b"), ([models[1]], "(OS == True) & (reg2j2b == True)")]
    df = wide_events(spark, sf)
    responses = ml.apply_all(df, KEY, trainings)
    for i, model in enumerate(models):
        df = ml.with_score(df, model, f"one{i}")
    own = F.when(F.expr(regions[0]), F.col("one0")).when(F.expr(regions[1]), F.col("one1")).otherwise(config.UNSCORED)
    # event_id may repeat: rows of equal keys are compared as sorted lists
    both = responses.groupBy(KEY).agg(F.sort_array(F.collect_list("response")).alias("_got"))
    wanted = df.groupBy(KEY).agg(F.sort_array(F.collect_list(own)).alias("_want"))
    rows = both.join(wanted, KEY).select(KEY, F.explode(F.arrays_zip("_got", "_want")).alias("_p"))
    rows = rows.select(KEY, F.col("_p._got").alias("response"), F.col("_p._want").alias("want"))
    return rows.select(KEY, *_scored(), (F.abs(F.col("response") - F.col("want")) < 1e-9).alias("of_own_region"))


@query("feature_importances_repeated", f"SELECT feature, true AS is_share, true AS sums_to_one, true AS in_order FROM ({_FEATURE_ROWS})")
def _(spark, sf):
    ranked = _facts(ml.feature_importances_repeated(_prepared(spark, sf), KEY, FEATURES, AXES, ROUNDS, n_fits=5))
    values = [r["importance"] for r in ranked.orderBy("position").collect()]
    return ranked.select(
        "feature",
        _share("importance", "is_share"),
        F.lit(abs(sum(values) - 1) < 1e-9).alias("sums_to_one"),
        F.lit(values == sorted(values, reverse=True)).alias("in_order"),
    )


@query("iterative_remove_auc", f"SELECT feature, true AS auc_is_share, true AS in_order FROM ({_FEATURE_ROWS})")
def _(spark, sf):
    ranked = _facts(ml.iterative_remove_auc(_prepared(spark, sf), KEY, FEATURES, AXES, ROUNDS))
    values = [r["auc"] for r in ranked.orderBy("position").collect()]
    return ranked.select("feature", _share("auc", "auc_is_share"), F.lit(values == sorted(values)).alias("in_order"))


@query(
    "iterative_add_auc",
    " UNION ALL ".join(f"SELECT {i} AS n, '{f}' AS feature, true AS auc_is_share" for i, f in enumerate(FEATURES, 1)),
)
def _(spark, sf):
    return ml.iterative_add_auc(_prepared(spark, sf), KEY, FEATURES, AXES, ROUNDS).select("n", "feature", _share("auc", "auc_is_share"))
