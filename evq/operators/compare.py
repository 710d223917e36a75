"""Comparing binned distributions. Inputs are histogram tables: at most one row per key and bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.functions.stats import chi2_prob, kolmogorov_prob


def pair_histograms(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``keys, bin, h1, e1, h2, e2``: two histogram tables matched on key and bin, a missing bin is 0."""
    left = first.select(*by, "bin", F.col("count").alias("h1"), F.col("err").alias("e1"))
    right = second.select(*by, "bin", F.col("count").alias("h2"), F.col("err").alias("e2"))
    return left.join(right, [*by, "bin"], "full_outer").na.fill(0.0, ["h1", "e1", "h2", "e2"])


def pair_by(hist: DataFrame, column: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """The same from one table whose ``column`` tells the two histograms apart (no join, one pass)."""

    def of(value, name):
        return F.coalesce(F.max(F.when(F.col(column) == value, F.col(name))), F.lit(0.0))

    return hist.groupBy(*by, "bin").agg(
        of(first, "count").alias("h1"),
        of(first, "err").alias("e1"),
        of(second, "count").alias("h2"),
        of(second, "err").alias("e2"),
    )


def _bins(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per pair of histograms, its bins (bounded by the binning) in order in ``_b``."""
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "h1", "e1", "h2", "e2"))).alias("_b"))


def _total(of):
    return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + of(b))


def ks_two_sample(pairs: DataFrame, by: Sequence[str] = (), cumulative: bool = False) -> DataFrame:
    """Binned two-sample test: ``ks_stat``, ``ks_z`` and ``ks_pvalue`` per pair of histograms.

    The default statistic is the largest difference between the two shapes in a
    single bin; ``cumulative`` compares running sums, the textbook statistic.
    """
    sums = _bins(pairs, by).withColumns(
        {
            "_s1": _total(lambda b: b["h1"]),
            "_s2": _total(lambda b: b["h2"]),
            "_w1": _total(lambda b: b["e1"] * b["e1"]),
            "_w2": _total(lambda b: b["e2"] * b["e2"]),
        }
    )
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("m"))

    def step(acc, b):
        d = F.try_divide(b["h1"], F.col("_s1")) - F.try_divide(b["h2"], F.col("_s2"))
        if cumulative:
            d = acc["d"] + d
        return F.struct(d.alias("d"), F.greatest(acc["m"], F.abs(d)).alias("m"))

    e1 = F.try_divide(F.col("_s1") * F.col("_s1"), "_w1")
    e2 = F.try_divide(F.col("_s2") * F.col("_s2"), "_w2")
    largest = F.when((F.col("_s1") != 0) & (F.col("_s2") != 0), F.aggregate("_b", start, step)["m"])
    return (
        sums.withColumns({"ks_stat": largest, "_e": F.sqrt(F.try_divide(e1 * e2, e1 + e2))})
        .withColumn("ks_z", F.col("ks_stat") * F.col("_e"))
        .withColumn("ks_pvalue", kolmogorov_prob(F.col("ks_z")))
        .select(*by, "ks_stat", "ks_z", "ks_pvalue")
    )


def chi2_two_sample(
    pairs: DataFrame, by: Sequence[str] = (), symmetric: bool = False, with_probability: bool = True
) -> DataFrame:
    """``chi2``, ``ndf`` and ``chi2_pvalue`` over the bins where neither histogram is 0.

    ``symmetric`` weighs the second error by the square of the first sum, as the
    two-histogram test is usually written; the default keeps the mixed product.
    """
    good = F.filter("_b", lambda b: (b["h1"] != 0) & (b["h2"] != 0))
    sums = (
        _bins(pairs, by)
        .withColumn("_b", good)
        .withColumns({"_s1": _total(lambda b: b["h1"]), "_s2": _total(lambda b: b["h2"])})
    )
    s1, s2 = F.col("_s1"), F.col("_s2")

    def term(b):
        second = s1 * s1 if symmetric else s1 * s2
        sigma = second * b["e2"] * b["e2"] + s2 * s2 * b["e1"] * b["e1"]
        delta = s2 * b["h1"] - s1 * b["h2"]
        return F.try_divide(delta * delta, sigma)

    out = sums.select(*by, _total(term).alias("chi2"), (F.size("_b") - 1).cast("int").alias("ndf"))
    if with_probability:
        out = out.withColumn("chi2_pvalue", chi2_prob(F.col("chi2"), F.col("ndf")))
    return out


def systematic_comparison(templates: DataFrame, nominal="nominal", up="up", down="down") -> DataFrame:
    """Add the percent difference of both variations to the nominal; null where the nominal is 0."""
    base = F.col(nominal)
    return templates.withColumns(
        {
            "percent_up": F.try_divide(F.col(up) - base, base) * 100.0,
            "percent_down": F.try_divide(F.col(down) - base, base) * 100.0,
        }
    )


def systematic_summary(comparison: DataFrame, by: Sequence[str] = (), up="up", down="down") -> DataFrame:
    """Smallest and largest percent difference and the highest variation, per key."""
    return comparison.groupBy(*by).agg(
        F.min(F.least("percent_up", "percent_down")).alias("percent_min"),
        F.max(F.greatest("percent_up", "percent_down")).alias("percent_max"),
        F.max(F.greatest(up, down)).alias("template_max"),
    )


def one_sided_systematic(templates: DataFrame, nominal="nominal", up="up") -> DataFrame:
    """Mirror the up variation around the nominal, then compare."""
    return systematic_comparison(
        templates.withColumn("down", F.lit(2.0) * F.col(nominal) - F.col(up)), nominal, up, "down"
    )


def template_triplets(templates: DataFrame, up: str, down: str, nominal: str = "weight_nominal") -> DataFrame:
    """Templates in long form (a ``weight`` column) to ``bin, lo, hi, nominal, up, down``."""

    def of(name):
        return F.max(F.when(F.col("weight") == name, F.col("count")))

    return templates.groupBy("bin", "lo", "hi").agg(
        of(nominal).alias("nominal"), of(up).alias("up"), of(down).alias("down")
    )
