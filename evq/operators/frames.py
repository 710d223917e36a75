"""Row selection, column rules and weight corrections. All lazy, none shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq import config
from evq.functions import keys
from evq.functions.regions import (
    Region,
    analysis_region,
    avoids_for,
    by_name,
    categorize_columns,
    features_for,
    region_label,
)
from evq.functions.selections import selection_columns, selection_for, selection_sql

WEIGHT = "weight_nominal"

# --- rows ---------------------------------------------------------------------


def selection_column(df: DataFrame, selection: str) -> Column:
    """A selection string as a predicate on ``df``."""
    return F.expr(selection_sql(selection, df.schema))


def where_selection(df: DataFrame, selection: str) -> DataFrame:
    return df.filter(selection_column(df, selection))


def select_region(df: DataFrame, region: str | Region, additional: str | None = None) -> DataFrame:
    return where_selection(df, selection_for(region, additional))


def add_region(df: DataFrame, name: str = "region") -> DataFrame:
    """Region of every event, so that one scan serves all regions."""
    return df.withColumn(name, region_label({c: c for c in df.columns}))


def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Replace NaN by null in the floating-point columns (default: all but the weights)."""
    if columns is None:
        columns = [c for c in df.columns if c not in categorize_columns(df.columns)["weights"]]
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in floating})


# --- columns ------------------------------------------------------------------


def select_category(df: DataFrame, category: str, weight_name: str | None = WEIGHT) -> DataFrame:
    names = set(categorize_columns(df.columns)[category])
    if weight_name is not None:
        names.add(weight_name)
    return df.select(*by_name(names))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def drop_avoid(df: DataFrame, region: str | Region | None = None) -> DataFrame:
    return df.drop(*config.AVOID, *(avoids_for(region) if region is not None else []))


def drop_jet2(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "jet2" in c])


def select_features(df: DataFrame, region: str | Region, extra=()) -> DataFrame:
    """The feature list of a region (``"ALL"``: of every region), plus ``extra`` columns."""
    features = features_for(region)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not in the table: {', '.join(missing)}")
    return df.select(*extra, *features)


def with_variable_binning(df: DataFrame, binning: DataFrame, region: str | Region) -> DataFrame:
    """Rows of a ``(region, var, nbins, xmin, xmax)`` table whose variable is a column of ``df``."""
    return binning.filter((F.col("region") == analysis_region(region)) & F.col("var").isin(*df.columns))


# --- weights ------------------------------------------------------------------


def weight_family(df: DataFrame, weight_name: str, exclude=()) -> list[str]:
    """The nominal weight and every systematic weight, without ``exclude`` and the factor itself."""
    family = [WEIGHT] + [c for c in df.columns if "weight_sys" in c]
    return [c for c in family if c in df.columns and c != weight_name and c not in set(exclude or ())]


def apply_weight(df: DataFrame, weight_name: str, exclude=()) -> DataFrame:
    factor = F.col(weight_name)
    return df.withColumns({c: F.col(c) * factor for c in weight_family(df, weight_name, exclude)})


def apply_weight_inverse(df: DataFrame, weight_name: str, exclude=()) -> DataFrame:
    """Divide the family by a weight; a zero weight gives null."""
    factor = F.col(weight_name)
    return df.withColumns({c: F.try_divide(F.col(c), factor) for c in weight_family(df, weight_name, exclude)})


def apply_weight_campaign(df: DataFrame, exclude=()) -> DataFrame:
    return apply_weight(df, "weight_campaign", exclude)


def apply_weight_tptrw(df: DataFrame, exclude=()) -> DataFrame:
    return apply_weight(df, "weight_tptrw_tool", ["weight_sys_noreweight", *(exclude or ())])


def apply_weight_trrw(df: DataFrame, exclude=()) -> DataFrame:
    return apply_weight(df, "weight_trrw_tool", ["weight_sys_noreweight", *(exclude or ())])


def clipped(weight: Column | str) -> Column:
    """Negative weights as 0; NaN and null stay."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.when(weight < 0, 0.0).otherwise(weight)


def clip_negative_weights(df: DataFrame, weight_name: str = WEIGHT) -> DataFrame:
    return df.withColumn(weight_name, clipped(weight_name))


def scale_by_lumi(df: DataFrame, lumi: float | None = None, weight_name: str = WEIGHT) -> DataFrame:
    return df.withColumn(weight_name, F.col(weight_name) * F.lit(config.LUMI if lumi is None else lumi))


# --- all at once --------------------------------------------------------------


def select_events(
    df: DataFrame,
    selection: str,
    weight_name: str = WEIGHT,
    columns=None,
    keep_category: str | None = None,
    exclude_avoids: bool = False,
    use_campaign_weight: bool = False,
    use_tptrw: bool = False,
    use_trrw: bool = False,
    sample_fraction: float | None = None,
    key: str | None = None,
) -> DataFrame:
    """Sample, correct the weights, filter, and keep the wanted columns in one scan.

    Kept: the requested columns (of ``keep_category`` if given), without avoided
    ones, plus the weight and, when named, the row ``key``. Columns used only by
    the selection are read but not kept. Sampling happens before the selection
    and needs ``key``.
    """
    wanted = set(df.columns if columns is None else columns)
    if keep_category is not None:
        kept = set(categorize_columns(wanted)[keep_category])
    else:
        kept = set(wanted)
    if exclude_avoids:
        kept -= set(config.AVOID)
    kept.add(weight_name)
    if key is not None:
        kept.add(key)

    factors = [
        (use_campaign_weight, "weight_campaign", apply_weight_campaign),
        (use_tptrw, "weight_tptrw_tool", apply_weight_tptrw),
        (use_trrw, "weight_trrw_tool", apply_weight_trrw),
    ]
    needed = kept | selection_columns(selection) | {name for used, name, _ in factors if used}
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")
    df = df.select(*by_name(needed))
    if sample_fraction is not None:
        if key is None:
            raise ValueError("sampling needs the name of the row key")
        df = df.filter(keys.in_fraction(key, sample_fraction))
    df = reduce(lambda table, step: step[2](table) if step[0] else table, factors, df)
    return where_selection(df, selection).select(*by_name(kept))
