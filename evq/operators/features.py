"""Feature statistics: constant columns, correlations, candidate features."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(df: DataFrame, columns) -> list[str]:
    if columns is not None:
        return list(columns)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _finite(name: str):
    """The column as double, NaN as null."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value`` of every column with exactly one distinct value; a column without values is kept out.

    Minimum equals maximum: one aggregate without a distinct shuffle.
    """
    columns = _numeric(df, columns)
    limits = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"), F.min(_finite(c)).alias("value"), F.max(_finite(c)).alias("top")
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return limits.select(F.inline(F.array(*limits.columns))).filter(F.col("value") == F.col("top")).drop("top")


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the constant columns (runs the one-row aggregate of :func:`constant_columns`)."""
    return df.drop(*[row["column"] for row in constant_columns(df, columns).collect()])


#: A spread of this many times the smallest relative step of a double, or less, is rounding: the column is constant.
ROUNDING = 8 * np.finfo(float).eps


#: Tasks per executor core that a correlation matrix reads the table with.
TASKS_PER_CORE = 4


class _Moments:
    """Counts, means and central moments of all pairs of columns over the rows where both are present.

    One array of six planes (rows, means of the first and the second column, both variances, covariance, the last
    three times the rows), so that a task's state is one value of features squared, and two states merge exactly.
    """

    def __init__(self, n: int) -> None:
        self.pairs, self.state = np.triu_indices(n, k=1), None

    def add(self, count, x, y, xx, yy, xy) -> None:
        new = np.stack([count, x, y, xx, yy, xy])
        if self.state is None:
            self.state = new
            return
        old, total = self.state, np.maximum(self.state[0] + count, 1)
        dx, dy, both = x - old[1], y - old[2], old[0] * count / total
        share = count / total
        self.state = np.stack(
            [old[0] + count, old[1] + dx * share, old[2] + dy * share, old[3] + xx + dx * dx * both, old[4] + yy + dy * dy * both, old[5] + xy + dx * dy * both]
        )

    def add_rows(self, x: np.ndarray) -> None:
        """Rows with NaN where a value is missing; shifted by the batch's own means, so that products do not cancel."""
        here = ~np.isnan(x)
        full = bool(here.all())
        shift = x.mean(axis=0) if full else np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
        a, b = self.pairs
        if full:  # the means are exact: one product says all
            product = (x - shift).T @ (x - shift)
            square = np.diag(product)
            self.add(np.full(len(a), float(len(x))), shift[a], shift[b], square[a], square[b], product[a, b])
            return
        m, x = here.astype(float), np.where(here, x - shift, 0.0)
        square = x * x
        count, sum_a, sum_b, xx, yy, xy = (p[a, b] for p in (m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x))
        safe = np.maximum(count, 1)
        self.add(count, shift[a] + sum_a / safe, shift[b] + sum_b / safe, xx - sum_a * sum_a / safe, yy - sum_b * sum_b / safe, xy - sum_a * sum_b / safe)

    def packed(self) -> Iterator[pa.RecordBatch]:
        if self.state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([self.state.tobytes()], pa.binary())], ["state"])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson coefficients of all feature pairs over the rows where both are present:
    ``pos_a, feature_a, pos_b, feature_b, coeff`` with ``pos_a < pos_b``; null where one of them does not vary there.

    One scan, by as many tasks as the cluster runs at a time and a few more: each adds up matrix products of its Arrow
    batches and sends its moments of all pairs as one value. Those merge exactly, in two steps: what is shuffled is
    features squared per core, whatever the size of the table.
    """
    columns = _numeric(df, columns)
    n, spark = len(columns), df.sparkSession
    tasks = TASKS_PER_CORE * max(1, spark.sparkContext.defaultParallelism)
    base = df.select(*[_finite(c).alias(f"_{i}") for i, c in enumerate(columns)]).coalesce(tasks)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = _Moments(n)
        for batch in batches:
            if batch.num_rows:
                moments.add_rows(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        yield from moments.packed()

    def merged(batches: Iterator[pa.RecordBatch]) -> _Moments:
        moments = _Moments(n)
        for batch in batches:
            for state in batch.column(0):
                moments.add(*np.frombuffer(state.as_buffer(), np.float64).reshape(6, -1))
        return moments

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = merged(batches)
        a, b = moments.pairs
        coeff = np.full(len(a), np.nan)
        if moments.state is not None:
            count, x, y, xx, yy, xy = moments.state
            varies = (xx > count * (ROUNDING * x) ** 2) & (yy > count * (ROUNDING * y) ** 2)
            coeff[varies] = xy[varies] / np.sqrt(xx[varies] * yy[varies])
        names = np.array(columns, dtype=object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(names[a], pa.string()), pa.array(b.astype(np.int32)), pa.array(names[b], pa.string()), pa.array(coeff, mask=np.isnan(coeff))],
            ["pos_a", "feature_a", "pos_b", "feature_b", "coeff"],
        )

    some = math.isqrt(tasks) + 1
    states = base.mapInArrow(of_rows, "state binary").repartition(some).mapInArrow(lambda batches: merged(batches).packed(), "state binary")
    return states.repartition(1).mapInArrow(coefficients, "pos_a int, feature_a string, pos_b int, feature_b string, coeff double")


def correlated_pairs(correlations: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``drop_this`` (the later column), ``because`` (the earlier one) and ``coeff`` above the threshold."""
    return correlations.filter(F.abs("coeff") > threshold).select(
        F.col("feature_b").alias("drop_this"), F.col("feature_a").alias("because"), "coeff"
    )


def feature_candidates(importances: DataFrame, pairs: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` features by importance without redundant ones: ``feature, importance``.

    A feature named as ``drop_this`` stays only if it is more important than a
    partner it correlates with, and that partner then leaves the list.
    """
    order = [F.col("importance").desc(), F.col("feature")]
    top = importances.select("feature", "importance").orderBy(*order).limit(n)
    partner = importances.select(F.col("feature").alias("because"), F.col("importance").alias("_other"))
    judged = (
        pairs.select(F.col("drop_this").alias("feature"), "because")
        .join(top, "feature")
        .join(partner, "because", "left")
        .withColumn(
            "_wins",
            (F.col("importance") > F.col("_other"))
            | ((F.col("importance") == F.col("_other")) & (F.col("feature") < F.col("because"))),
        )
    )
    winners = judged.filter("_wins")
    unpaired = top.join(pairs.select(F.col("drop_this").alias("feature")), "feature", "left_anti")
    kept = unpaired.unionByName(winners.select("feature", "importance").distinct())
    beaten = winners.select(F.col("because").alias("feature"))
    return kept.join(beaten, "feature", "left_anti").orderBy(*order)


def save_feature_result(path: str, result: dict) -> None:
    """Small driver-side results (AUC lists, ranked features, model parameters) as one-row JSON."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
