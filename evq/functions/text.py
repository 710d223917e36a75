"""Labels and short texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import config


def prettify_label(label: Column) -> Column:
    for old, new in config.LABEL_REPLACEMENTS:
        label = F.replace(label, F.lit(old), F.lit(new))
    return label


def meta_text(region: Column, stage: Column) -> Column:
    """``$tW$ Dilepton, {region}, {stage}``; null for an unknown region or stage."""
    name = F.lit(None).cast("string")
    for known in reversed(list(config.SELECTIONS)):
        name = F.when(F.contains(region, F.lit(known)), F.lit(known)).otherwise(name)
    when = F.when(stage == "pre", F.lit("Pre-fit")).when(stage == "post", F.lit("Post-fit"))
    return F.concat(F.lit("$tW$ Dilepton, "), name, F.lit(", "), when)


def title_key(region: Column) -> Column:
    """Name to look up in the titles table: a validation region drops its 12-character prefix."""
    return F.when(F.contains(region, F.lit("VRP")), F.substring(region, 13, 2**30)).otherwise(region)


def axis_label(df: DataFrame, titles: DataFrame, region: str = "region", bin_width: str = "bin_width") -> DataFrame:
    """Add ``x_label`` and ``y_label`` from a ``(name, mpl, unit)`` titles table (Spark sizes the join)."""
    names = titles.select(F.col("name").alias("_title"), F.col("mpl").alias("_mpl"), F.col("unit").alias("_unit"))
    has_unit = F.length(F.coalesce("_unit", F.lit(""))) > 0
    width = F.col(bin_width).cast("double")
    shown = F.when(width == F.floor(width), F.floor(width).cast("string")).otherwise(F.format_string("%.2f", width))
    return (
        df.withColumn("_title", title_key(F.col(region)))
        .join(names, "_title", "left")
        .withColumns(
            {
                "x_label": F.when(has_unit, F.concat("_mpl", F.lit(" ["), "_unit", F.lit("]"))).otherwise(F.col("_mpl")),
                "y_label": F.when(
                    F.col("_mpl").isNotNull(),
                    F.concat(F.lit("Events/"), shown, F.when(has_unit, F.concat(F.lit(" "), "_unit")).otherwise("")),
                ),
            }
        )
        .drop("_title", "_mpl", "_unit")
    )


def chisq_text(chi2: Column, ndof: Column, probability: Column) -> Column:
    return F.concat(
        F.format_string(r"$\chi^2/\mathrm{ndf} = %3.2f / %d$, ", chi2.cast("double"), ndof.cast("long")),
        F.format_string(r"$\chi^2_{\mathrm{prob}} = %3.2f$", probability.cast("double")),
    )


def log_scale_flag(region: Column) -> Column:
    """Does the region name match one of the configured patterns?"""
    flag = F.lit(False)
    for pattern in config.LOG_SCALE_PATTERNS:
        flag = flag | region.rlike(pattern)
    return flag
