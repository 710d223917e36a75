"""Weighted ROC, AUC and response shapes without a global sort.

Weights are summed per exact score, map-side first. Scores then fall into cells
of a monotone function of their exponent and leading mantissa bits, and the cells
fold level by level: whatever the number, range or crowding of the scores, a
window never holds more than about a million distinct scores, 65,536 cells or
4,096 top cells, and the order inside the finest cell is that of the exact score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.binning import ranged
from evq.operators.compare import ks_two_sample, pair_by
from evq.operators.hist import densify, density_histogram

#: Bits of a cell's number that one level folds away, and levels above the finest cells.
FOLD_BITS = 16
LEVELS = 2


def _score_sums(df: DataFrame, score: str, label: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: signal and background weight (``s``, ``b``) and the finest cell. A missing score is an error."""
    is_signal = F.col(label) == 1
    w = F.col(weight)
    value = F.col(score).cast("double")
    missing = value.isNull() | F.isnan(value)
    return (
        df.select(
            *by,
            F.when(missing, F.raise_error(F.lit(f"{score} has null or NaN values: filter or fill them first"))).otherwise(value).alias("value"),
            F.when(is_signal, w).otherwise(0.0).alias("s"),
            F.when(is_signal, 0.0).otherwise(w).alias("b"),
        )
        .groupBy(*by, "value")
        .agg(F.sum("s").alias("s"), F.sum("b").alias("b"))
        .withColumn("cell", _cell(F.col("value")))
    )


def _cell(value: Column) -> Column:
    """A non-decreasing integer function of the score: sign, binary exponent, leading 32 bits of the mantissa."""
    size = F.abs(value)
    exponent = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 2.0**-32), size / F.pow(F.lit(2.0), exponent) - 1.0))
    number = ((exponent + 1023.0) * 2.0**32 + F.floor(lead * 2.0**32)).cast("long") + 1
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, number).otherwise(-number)


def _parent(cell: Column) -> Column:
    return F.shiftright(cell, FOLD_BITS)


def _above(by: Sequence[str], *partition: str, order: str = "cell"):
    """Everything in the same partition that is higher."""
    keys = [*by, *partition] or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)


def weighted_auc(
    df: DataFrame, score: str = "score", label: str = "label", weight: str = "weight", by: Sequence[str] = ()
) -> DataFrame:
    """Area under the weighted ROC curve: ``auc`` (null when a class has no weight), per key.

    The area of a cell and of its children obey
    ``area = sum(child area) + sum(child b * signal weight in higher children)``,
    so one window and one aggregate per level are enough and nothing is joined back.
    """
    rows = _score_sums(df, score, label, weight, by).withColumn("area", F.col("s") * F.col("b") * 0.5)
    cells, order = rows.withColumnRenamed("cell", "_up"), "value"
    for level in range(LEVELS + 1):
        higher = F.coalesce(F.sum("s").over(_above(by, "_up", order=order)), F.lit(0.0))
        cells = (
            cells.withColumn("area", F.col("area") + F.col("b") * higher)
            .groupBy(*by, "_up")
            .agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("area").alias("area"))
            .withColumnRenamed("_up", "cell")
        )
        if level < LEVELS:
            cells, order = cells.withColumn("_up", _parent(F.col("cell"))), "cell"
    higher = F.coalesce(F.sum("s").over(_above(by)), F.lit(0.0))
    return (
        cells.withColumn("area", F.col("area") + F.col("b") * higher)
        .groupBy(*by)
        .agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("area").alias("area"))
        .select(*by, F.try_divide(F.col("area"), F.col("s") * F.col("b")).alias("auc"))
    )


def roc_curve(
    df: DataFrame, score: str = "score", label: str = "label", weight: str = "weight", by: Sequence[str] = ()
) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score (a row passes when its score is at least the threshold)."""
    return _points(df, score, label, weight, by).select(
        *by,
        F.col("value").alias("threshold"),
        F.try_divide("b_in", "b_all").alias("fpr"),
        F.try_divide("s_in", "s_all").alias("tpr"),
    )


def _points(df, score, label, weight, by) -> DataFrame:
    """Distinct scores with the weights at or above them and the totals.

    Each level's cells get the running sum inside their parent; a cell's offset adds up those of
    its ancestors. The levels are joined null-safe: groups with a null key stay, and no null
    filter is pushed into one branch only, so the branches share one scan and one shuffle of
    the events.
    """
    points = _score_sums(df, score, label, weight, by)
    every = Window.partitionBy(*(list(by) or [F.lit(0)]))
    levels = [points.groupBy(*by, "cell").agg(F.sum("s").alias("s"), F.sum("b").alias("b"))]
    for _ in range(LEVELS):
        up = levels[-1].select(*by, _parent(F.col("cell")).alias("cell"), "s", "b")
        levels.append(up.groupBy(*by, "cell").agg(F.sum("s").alias("s"), F.sum("b").alias("b")))
    offsets = levels[-1].select(
        *by,
        "cell",
        *[F.coalesce(F.sum(c).over(_above(by)), F.lit(0.0)).alias(f"{c}_above") for c in "sb"],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in "sb"],
    )
    for level in reversed(levels[:-1]):
        inside = level.withColumn("_up", _parent(F.col("cell")))
        inside = inside.select(*by, "cell", "_up", *[F.coalesce(F.sum(c).over(_above(by, "_up")), F.lit(0.0)).alias(f"{c}_here") for c in "sb"])
        both = _joined(inside, offsets.withColumnRenamed("cell", "_up"), [*by, "_up"])
        offsets = both.select(*by, "cell", *[(F.col(f"{c}_here") + F.col(f"{c}_above")).alias(f"{c}_above") for c in "sb"], "s_all", "b_all")
    within = Window.partitionBy(*by, "cell").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(points.withColumns({f"{c}_here": F.sum(c).over(within) for c in "sb"}), offsets, [*by, "cell"]).select(
        *by, "value", *[(F.col(f"{c}_here") + F.col(f"{c}_above")).alias(f"{c}_in") for c in "sb"], "s_all", "b_all"
    )


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe equi-join; the keys are kept once."""
    marks = {f"_right{i}": k for i, k in enumerate(keys)}
    right = right.select(*[F.col(k).alias(m) for m, k in marks.items()], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(m)) for m, k in marks.items()]
    return left.join(right, same).drop(*marks)


def mean_roc(
    df: DataFrame,
    fold: str = "fold",
    score: str = "score",
    label: str = "label",
    weight: str = "weight",
    points: int = 100,
) -> DataFrame:
    """Mean curve over the folds on an even grid: ``point, fpr, tpr`` (0 at the first, 1 at the last point).

    A fold's curve point can only be the left neighbour of grid points from
    ``ceil(fpr * last)`` on and the right neighbour of those before, so one
    aggregate per (fold, grid interval) keeps all that interpolation needs.
    """
    last = points - 1
    # Rounding and clamping keep the sums' last-digit noise from moving a point to another interval.
    curve = roc_curve(df, score, label, weight, [fold]).select(
        fold, *[F.least(F.round(c, 12), F.lit(1.0)).alias(c) for c in ("fpr", "tpr")]
    )
    spot = F.struct(F.col("fpr").alias("f"), F.col("tpr").alias("t"))
    cells = curve.groupBy(fold, F.ceil(F.col("fpr") * last).cast("int").alias("point")).agg(
        F.max(spot).alias("left"), F.min(spot).alias("right")
    )
    filled = cells.groupBy(fold).agg(
        F.map_from_entries(F.collect_list(F.struct("point", F.struct("left", "right")))).alias("_m")
    )
    grid = filled.select(fold, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("point"), "_m").select(
        fold,
        "point",
        F.try_element_at("_m", F.col("point"))["left"].alias("left"),
        F.try_element_at("_m", F.col("point"))["right"].alias("right"),
    )
    upto = Window.partitionBy(fold).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(fold).orderBy("point").rowsBetween(1, Window.unboundedFollowing)
    x = F.col("point") / F.lit(float(last))
    origin = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("t"))
    neighbours = grid.select(
        fold,
        "point",
        F.coalesce(F.last("left", ignorenulls=True).over(upto), origin).alias("l"),
        F.first("right", ignorenulls=True).over(after).alias("r"),
    )
    slope = F.try_divide(F.col("r.t") - F.col("l.t"), F.col("r.f") - F.col("l.f"))
    tpr = F.col("l.t") + F.coalesce(slope * (x - F.col("l.f")), F.lit(0.0))
    per_fold = neighbours.select("point", F.when(F.col("point") == 0, 0.0).otherwise(tpr).alias("tpr"))
    return (
        per_fold.groupBy("point")
        .agg(F.avg("tpr").alias("tpr"))
        .select("point", x.alias("fpr"), F.when(F.col("point") == last, 1.0).otherwise(F.col("tpr")).alias("tpr"))
    )


def fold_summary(
    df: DataFrame,
    fold: str = "fold",
    score: str = "score",
    label: str = "label",
    weight: str = "weight",
    points: int = 100,
) -> DataFrame:
    """One row: ``auc`` of the mean curve, ``auc_std`` over the folds, and ``score = -mean(fold AUC)``."""
    curve = mean_roc(df, fold, score, label, weight, points)
    ends = F.when(F.col("point").isin(0, points - 1), F.col("tpr") * 0.5).otherwise(F.col("tpr"))
    area = curve.agg((F.sum(ends) / F.lit(float(points - 1))).alias("auc")).scalar()
    folds = weighted_auc(df, score, label, weight, [fold])
    return folds.agg(
        F.stddev_pop("auc").alias("auc_std"),
        (-F.avg("auc")).alias("score"),
        F.count(F.lit(1)).cast("int").alias("folds"),
    ).select(area.alias("auc"), "auc_std", "score", "folds")


def response_histograms(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    weight: str = "weight",
    split: str = "split",
    nbins: int = 30,
) -> DataFrame:
    """Unit-area response shapes ``split, label, bin, lo, hi, count, err`` from the lowest background to the
    highest signal score; the range is a subquery, so the plan stays lazy."""
    x = F.col(score)
    limits = df.agg(
        F.struct(
            F.min(F.when(F.col(label) == 0, x)).alias("lo"), F.max(F.when(F.col(label) == 1, x)).alias("hi")
        )
    ).scalar()
    lo, hi = limits.getField("lo"), limits.getField("hi")
    width = (hi - lo) / F.lit(nbins)
    inside = F.least(F.floor(F.try_divide(x - lo, width)).cast("int"), F.lit(nbins - 1))
    w = F.col(weight)
    keys = [split, label]
    sums = (
        df.select(*keys, ranged(x, lo, hi, inside, nbins - 1).alias("bin"), weight)
        .groupBy(*keys, "bin")
        .agg(F.sum(w).alias("count"), F.sqrt(F.sum(w * w)).alias("err"))
    )
    dense = densify(sums, keys, nbins, ["count", "err"]).select(
        *keys,
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == nbins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("hi"),
        "count",
        "err",
    )
    return density_histogram(dense, keys)


def response_ks(hist: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Train against test shapes: one row ``ks_test_sig, ks_pvalue_sig, ks_test_bkg, ks_pvalue_bkg``, to 5 digits."""
    tests = ks_two_sample(pair_by(hist, split, "train", "test", [label]), [label])

    def of(value, name):
        return F.round(F.max(F.when(F.col(label) == value, F.col(name))), 5)

    return tests.agg(
        of(1, "ks_stat").alias("ks_test_sig"),
        of(1, "ks_pvalue").alias("ks_pvalue_sig"),
        of(0, "ks_stat").alias("ks_test_bkg"),
        of(0, "ks_pvalue").alias("ks_pvalue_bkg"),
    )


def training_quality(summary: DataFrame) -> DataFrame:
    """Add ``bad_ks``: train and test shapes disagree for signal or background."""
    return summary.withColumn("bad_ks", (F.col("ks_pvalue_sig") < 0.2) | (F.col("ks_pvalue_bkg") < 0.2))
