"""Position of every row in a sorted group of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the rows are dealt to: COARSE times COARSE, found in two steps of COARSE comparisons.
COARSE = 32


def with_range(df: DataFrame, value: Column) -> DataFrame:
    """Add ``_range``, where the value lies between the quantiles of all values: 0 for the smallest, -1 for null.

    The split points are a scalar subquery, evaluated once and then constants: a part that is computed again after
    a lost executor finds the same ranges.
    """
    n = COARSE * COARSE
    points = df.select(value.alias("_v")).agg(F.percentile_approx("_v", [i / n for i in range(1, n)], 10 * n).alias("_p"))
    coarse = F.array(*[F.element_at("_p", i * COARSE) for i in range(1, COARSE)])
    fine = F.array(*[F.slice("_p", i * COARSE + 1, COARSE - 1) for i in range(COARSE)])
    split = points.select(F.struct(coarse.alias("coarse"), fine.alias("fine"))).scalar()

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda p: p <= value))

    found = df.withColumn("_split", split).withColumn("_step", below(F.col("_split.coarse")))
    place = F.col("_step") * COARSE + below(F.element_at("_split.fine", F.col("_step") + 1))
    return found.withColumn("_range", F.when(value.isNull(), -1).otherwise(place)).drop("_split", "_step")


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, value: Column) -> DataFrame:
    """Add the 0-based position of each row within its group in the given (unique) order, nulls first.

    ``value`` is the number that the order starts with. A window over the group would put a hot group into one task.
    Here the rows of a group are dealt to ranges between quantiles of ``value``, numbered inside their range, and
    shifted by the sizes of the ranges before. Only rows of equal ``value`` stay together. Nothing is written.
    """
    placed = with_range(df, value.cast("double"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    numbered = placed.withColumn("_inside", inside).join(sizes, same)
    return numbered.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int")).select(*df.columns, name)
