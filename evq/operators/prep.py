"""Training tables: signal and background united, labelled and weight-normalised.

Normalisation factors are scalar subqueries over one partial aggregate, so they
stay inside the plan: nothing is collected and nothing is shuffled but sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import config
from evq.functions.regions import Region, analysis_region, avoids_for, by_name, features_for
from evq.functions.selections import selection_for
from evq.operators.frames import WEIGHT, clip_negative_weights, select_events
from evq.operators.sampling import sample_fraction, sample_n_per_class


def _class_sums(df: DataFrame, label: str, weight: str) -> Column:
    is_signal = F.col(label) == 1
    w = F.col(weight)
    return df.agg(
        F.struct(
            F.sum(F.when(is_signal, w)).alias("signal"),
            F.sum(F.when(~is_signal, w)).alias("background"),
            F.sum(w).alias("all"),
            F.count(F.lit(1)).alias("rows"),
        )
    ).scalar()


def scale_sum_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Scale the signal weights so that their sum is that of the background."""
    sums = _class_sums(df, label, weight)
    factor = F.try_divide(sums.getField("background"), sums.getField("signal"))
    return df.withColumn(weight, F.when(F.col(label) == 1, F.col(weight) * factor).otherwise(F.col(weight)))


def normalize_mean_weight(df: DataFrame, mean: float = 1.0, weight: str = "weight") -> DataFrame:
    """Scale all weights so that their mean is ``mean``."""
    sums = df.agg(F.struct(F.sum(weight).alias("all"), F.count(F.lit(1)).alias("rows"))).scalar()
    factor = F.try_divide(F.lit(float(mean)) * sums.getField("rows"), sums.getField("all"))
    return df.withColumn(weight, F.col(weight) * factor)


def _normalized(
    df: DataFrame, scale_sums: bool, weight_mean: float | None, weight_scale: float | None
) -> DataFrame:
    """Both normalisations from the same sums: a scaled signal has the background's sum by construction."""
    label, weight = F.col("label"), F.col("weight")
    if scale_sums or weight_mean is not None:
        sums = _class_sums(df, "label", "weight")
    value, total = weight, None
    if scale_sums:
        factor = F.try_divide(sums.getField("background"), sums.getField("signal"))
        value = F.when(label == 1, weight * factor).otherwise(weight)
        total = 2.0 * sums.getField("background")
    elif weight_mean is not None:
        total = sums.getField("all")
    if weight_scale is not None:
        value = value * F.lit(float(weight_scale))
    if weight_mean is not None:
        value = value * F.try_divide(F.lit(float(weight_mean)) * sums.getField("rows"), total)
    return df.withColumn("weight", value)


def _united(signal: DataFrame, background: DataFrame, key: str | None) -> DataFrame:
    """Clip, drop the campaign weight, sort the columns, label and unite."""
    parts = []
    for part, label in ((signal, 1), (background, 0)):
        part = clip_negative_weights(part).drop("weight_campaign")
        features = by_name(c for c in part.columns if c not in (WEIGHT, key))
        head = [key] if key is not None else []
        parts.append(
            (features, part.select(*head, *features, F.lit(label).alias("label"), F.col(WEIGHT).alias("weight")))
        )
    if parts[0][0] != parts[1][0]:
        raise ValueError(f"signal and background columns differ: {parts[0][0]} and {parts[1][0]}")
    return parts[0][1].unionByName(parts[1][1])


def _check(weight_mean, weight_scale):
    if weight_mean is not None and weight_scale is not None:
        raise ValueError("weight_mean and weight_scale exclude each other")


def prepare_training(
    signal: DataFrame,
    background: DataFrame,
    region: str | Region,
    key: str | None = None,
    columns=None,
    override_selection: str | None = None,
    weight_mean: float | None = None,
    weight_scale: float | None = None,
    scale_sums: bool = True,
    use_campaign_weight: bool = False,
    use_tptrw: bool = False,
    use_trrw: bool = False,
    n_per_class: int | None = None,
    background_fraction: float | None = None,
) -> DataFrame:
    """``(key,) features..., label, weight`` of a region. The background alone gets the
    top-pT and recursive corrections and the sampling."""
    _check(weight_mean, weight_scale)
    selection = override_selection or selection_for(region)
    columns = features_for(region) if columns is None else columns
    shared = dict(
        selection=selection,
        columns=columns,
        keep_category="kinematics",
        exclude_avoids=True,
        use_campaign_weight=use_campaign_weight,
        key=key,
    )
    signal = select_events(signal, **shared)
    background = select_events(
        background, use_tptrw=use_tptrw, use_trrw=use_trrw, sample_fraction=background_fraction, **shared
    )
    table = _united(signal, background, key)
    if n_per_class is not None:
        table = sample_n_per_class(table, n_per_class, _required(key))
    return _normalized(table, scale_sums, weight_mean, weight_scale)


def prepare_from_samples(
    signal: DataFrame,
    background: DataFrame,
    region: str | Region,
    key: str | None = None,
    background_fraction: float | str | None = None,
    weight_mean: float | None = None,
    weight_scale: float | None = None,
    scale_sums: bool = True,
    n_per_class: int | None = None,
) -> DataFrame:
    """The same from tables already selected for the region; systematic weights are dropped."""
    _check(weight_mean, weight_scale)
    if background_fraction is not None and n_per_class is not None:
        raise ValueError("background_fraction and n_per_class exclude each other")
    signal, background = (
        part.drop(*[c for c in part.columns if "weight_sys" in c]) for part in (signal, background)
    )
    if background_fraction == "auto":
        background_fraction = config.AUTO_BACKGROUND_FRACTION[analysis_region(region)]
    if background_fraction is not None and background_fraction < 1:
        background = sample_fraction(background, background_fraction, _required(key))
    table = _united(signal, background, key)
    if n_per_class is not None:
        table = sample_n_per_class(table, n_per_class, _required(key))
    return _normalized(table, scale_sums, weight_mean, weight_scale)


def _required(key):
    if key is None:
        raise ValueError("sampling needs the name of the row key")
    return key


def input_groups(
    nlo_method: str = "DR", dilepton: bool = True, multiple_ttbar: bool = False, inclusive_afii: bool = False
) -> tuple[list[str], list[str]]:
    """Names of the signal and background sample groups of a training."""
    signal = f"tW_{nlo_method}" if dilepton else f"tW_{nlo_method}_inc"
    if multiple_ttbar:
        return [signal], ["ttbar_inc_AFII", "ttbar_PS"]
    if inclusive_afii:
        return [f"tW_{nlo_method}_inc_AFII"], ["ttbar_inc_AFII"]
    return [signal], ["ttbar" if dilepton else "ttbar_inc"]


def select_input_samples(
    df: DataFrame,
    region: str | Region,
    nlo_method: str = "DR",
    dilepton: bool = True,
    multiple_ttbar: bool = False,
    inclusive_afii: bool = False,
    ignore=(),
    group: str = "sample_group",
    **prepare,
) -> DataFrame:
    """Training table from a table with a ``sample_group`` column: choose the groups, prepare with a mean
    weight of 1, and drop the region's avoided columns and the ``ignore`` list."""
    signal, background = input_groups(nlo_method, dilepton, multiple_ttbar, inclusive_afii)
    prepare.setdefault("weight_mean", 1.0)
    table = prepare_training(
        df.filter(F.col(group).isin(*signal)), df.filter(F.col(group).isin(*background)), region, **prepare
    )
    return table.drop(*avoids_for(region), *ignore)
