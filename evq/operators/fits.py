"""Analysis of fit results: tables with one row per fit and parameter.

``fit`` is a plain string or, over several workspaces, the key of :mod:`evq.functions.fit_keys`; a fit is named by
a string or a ``FitKey`` accordingly.

Two fits are compared by one conditional aggregate per parameter (one scan, a
map-side partial) instead of a self-join; the configuration tables that name
fits are joined without a hint, so Spark sizes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq import config
from evq.functions.fit_keys import FitKey, has_keys, is_fit
from evq.functions.text import prettify_label
from evq.plans.positions import with_position

IMPACTS = ["pre_down", "pre_up", "post_down", "post_up"]


def with_post_max(df: DataFrame) -> DataFrame:
    return df.withColumn("post_max", F.greatest(F.abs("post_down"), F.abs("post_up")))


def np_impacts(df: DataFrame) -> DataFrame:
    """Nuisance parameters with ``post_max``, in ascending order of it."""
    return with_post_max(df).orderBy("post_max", "name")


def top_impacts(df: DataFrame, n: int = 20, fit: str = "fit") -> DataFrame:
    """The ``n`` parameters of each fit with the largest ``post_max``, with their ``rank``.

    The rank limit lets Spark keep only ``n`` rows per fit and task before the shuffle.
    """
    largest = Window.partitionBy(fit).orderBy(F.col("post_max").desc(), F.col("name"))
    return with_post_max(df).withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= n)


def impact_bars(df: DataFrame, n: int | None = 20, fit: str = "fit") -> DataFrame:
    """Bar geometry per fit: where each of the four bars starts, a readable label, and the vertical
    position ``ys`` in ascending order of impact. ``n=None`` places all parameters."""
    ascending = [F.col("post_max"), F.col("name").desc()]
    if n is None:
        placed = with_position(with_post_max(df), [fit], ascending, "ys", F.col("post_max"))
    else:
        top = top_impacts(df, n, fit).drop("rank")
        placed = top.withColumn("ys", F.row_number().over(Window.partitionBy(fit).orderBy(*ascending)) - 1)
    return placed.withColumns(
        {
            **{f"{c}_left": F.least(F.col(c), F.lit(0.0)) for c in IMPACTS},
            "label": prettify_label(F.col("name")),
        }
    )


# --- two fits -------------------------------------------------------------------


Fit = str | FitKey


def _of(fit: str, value: Fit, column: str) -> Column:
    return F.max(F.when(is_fit(fit, value), F.col(column)))


def paired_fits(df: DataFrame, first: Fit, second: Fit, columns: Sequence[str], fit: str = "fit") -> DataFrame:
    """``name`` and ``{column}_1, {column}_2`` of the parameters present in both fits."""
    both = df.filter(is_fit(fit, first) | is_fit(fit, second)).groupBy("name")
    wide = both.agg(
        F.count(F.when(is_fit(fit, first), 1)).alias("_n1"),
        F.count(F.when(is_fit(fit, second), 1)).alias("_n2"),
        *[_of(fit, f, c).alias(f"{c}_{i}") for c in columns for i, f in ((1, first), (2, second))],
    )
    return wide.filter((F.col("_n1") > 0) & (F.col("_n2") > 0)).drop("_n1", "_n2")


def _delta(c1, c2, hi1, hi2, lo1, lo2) -> dict[str, Column]:
    return {
        "delta": c1 - c2,
        "delta_up": F.sqrt(hi1 * hi1 + hi2 * hi2),
        "delta_down": F.sqrt(lo1 * lo1 + lo2 * lo2),
    }


def delta_param(df: DataFrame, first: Fit, second: Fit, fit: str = "fit") -> DataFrame:
    """Difference of every common parameter with its propagated up and down uncertainty."""
    wide = paired_fits(df, first, second, ["central", "sig_hi", "sig_lo"], fit)
    parts = [F.col(f"{c}_{i}") for c in ("central", "sig_hi", "sig_lo") for i in (1, 2)]
    return wide.select("name", *[c.alias(n) for n, c in _delta(*parts).items()])


def delta_poi(df: DataFrame, first: Fit, second: Fit, poi: str = config.DEFAULT_POI, fit: str = "fit") -> DataFrame:
    return delta_param(df.filter(F.col("name") == poi), first, second, fit)


def _percent_larger(a: Column, b: Column) -> Column:
    """How much the larger magnitude exceeds the smaller, in percent; null when the smaller is 0."""
    big, small = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return F.try_divide(big - small, small) * 100.0


def _compared(wide: DataFrame, quantities: dict[str, tuple[str, str]], first: Fit, second: Fit) -> DataFrame:
    """One row per parameter and quantity. ``quantities`` maps the name shown to (column, rule)."""
    entries = []
    for shown, (column, rule) in quantities.items():
        a, b = F.col(f"{column}_1"), F.col(f"{column}_2")
        larger = F.when(F.abs(a) > F.abs(b), F.lit(str(first))).otherwise(F.lit(str(second)))
        if rule == "tighter":
            larger = F.when(F.abs(a) < F.abs(b), F.lit(str(first))).otherwise(F.lit(str(second)))
            change = F.abs(F.abs(a) - F.abs(b))
        else:
            change = _percent_larger(a, b)
        entries.append(
            F.struct(
                F.lit(shown).alias("quantity"),
                a.alias("value_1"),
                b.alias("value_2"),
                F.lit(rule).alias("rule"),
                larger.alias("which"),
                change.alias("change"),
            )
        )
    return wide.select("name", F.inline(F.array(*entries)))


def compare_uncertainty(df: DataFrame, first: Fit, second: Fit, fit: str = "fit") -> DataFrame:
    """Which fit has the larger up and down uncertainty on each common parameter, and by how many percent."""
    wide = paired_fits(df, first, second, ["sig_hi", "sig_lo"], fit)
    return _compared(wide, {"up": ("sig_hi", "larger"), "down": ("sig_lo", "larger")}, first, second)


def compare_nuispar(df: DataFrame, first: Fit, second: Fit, fit: str = "fit") -> DataFrame:
    """Constraints (tighter, absolute difference) and impacts (larger, percent) of each common parameter."""
    columns = {
        "sig_lo": ("sig_lo", "tighter"),
        "sig_hi": ("sig_hi", "tighter"),
        "pre_up": ("pre_up", "larger"),
        "pre_down": ("pre_down", "larger"),
        "post_up": ("post_up", "larger"),
        "post_down": ("post_down", "larger"),
    }
    return _compared(paired_fits(df, first, second, list(columns), fit), columns, first, second)


def comparison_summary(
    df: DataFrame, first: Fit, second: Fit, poi: str = config.DEFAULT_POI, nuispars: Sequence[str] = (), fit: str = "fit"
) -> DataFrame:
    """Uncertainty comparison of the parameter of interest and the named nuisance parameters, as one table."""
    mu = compare_uncertainty(df.filter(F.col("name") == poi), first, second, fit)
    nps = compare_nuispar(df.filter(F.col("name").isin(*nuispars)), first, second, fit)
    return mu.unionByName(nps)


# --- one nominal fit against many -----------------------------------------------


def _measured() -> Column:
    return F.struct(*[F.max(c).alias(c) for c in ("central", "sig_hi", "sig_lo")])


def _nominal(df: DataFrame, nominal: Fit, parameter: str, fit: str) -> Column:
    """The nominal values of one parameter as a one-row subquery."""
    return df.filter(is_fit(fit, nominal) & (F.col("name") == parameter)).agg(_measured()).scalar()


def _against_nominal(rows: DataFrame, nominal: Column, keep: Sequence[str]) -> DataFrame:
    deltas = _delta(
        nominal.getField("central"),
        F.col("central"),
        nominal.getField("sig_hi"),
        F.col("sig_hi"),
        nominal.getField("sig_lo"),
        F.col("sig_lo"),
    )
    return rows.select(*keep, *[c.alias(n) for n, c in deltas.items()])


def excluded_systematics_delta(
    df: DataFrame, nominal: str = "tW", poi: str = config.DEFAULT_POI, fit: str = "fit"
) -> DataFrame:
    """Change of the parameter of interest in each ``{nominal}_exclude-{NP}`` fit, ordered by NP name.

    Over several workspaces, each of them against its own nominal fit, with the ``workspace`` as first column.
    """
    keyed = has_keys(df, fit)
    file = F.col(fit).getField("file") if keyed else F.col(fit)
    prefix = f"{nominal}_exclude-"
    measured = df.filter(F.col("name") == poi)
    rows = (
        measured.filter(file.startswith(prefix))
        .withColumn("excluded", F.substring(file, len(prefix) + 1, 2**30))
        .filter(~F.contains(F.col("excluded"), F.lit("saturatedModel")))
        .withColumn("label", prettify_label(F.col("excluded")))
    )
    order = [F.lower("excluded"), "excluded"]
    if not keyed:
        return _against_nominal(rows, _nominal(df, nominal, poi, fit), ["excluded", "label"]).orderBy(*order)
    of = F.col(fit).getField("workspace").alias("workspace")
    nominals = measured.filter(file == nominal).groupBy(of).agg(_measured().alias("_nominal"))
    both = rows.withColumn("workspace", of).join(nominals, "workspace")
    return _against_nominal(both, F.col("_nominal"), ["workspace", "excluded", "label"]).orderBy("workspace", *order)


def config_delta(
    df: DataFrame, configs: DataFrame, nominal: Fit, poi: str = config.DEFAULT_POI, fit: str = "fit"
) -> DataFrame:
    """Change of the parameter of interest in each fit of a ``(config, label, fit)`` table."""
    rows = df.filter(F.col("name") == poi).join(configs.filter(~is_fit(fit, nominal)), fit)
    return _against_nominal(rows, _nominal(df, nominal, poi, fit), ["config", "label"])


def region_delta(df, configs, nominal, poi: str = config.DEFAULT_POI, fit: str = "fit") -> DataFrame:
    """:func:`config_delta` over the region set-ups (1j1b, 1j1b2j1b, 1j1b2j2b)."""
    return config_delta(df, configs.filter(F.col("config").rlike("^[12]j[12]b")), nominal, poi, fit)


def campaign_delta(df, configs, nominal, poi: str = config.DEFAULT_POI, fit: str = "fit") -> DataFrame:
    """:func:`config_delta` over the data-taking periods (1516, 17, 18)."""
    return config_delta(df, configs.filter(F.col("config").rlike("^1[5-8]")), nominal, poi, fit)


def param_pulls_by_config(df: DataFrame, configs: DataFrame, parameter: str, fit: str = "fit") -> DataFrame:
    """One parameter across fit configurations; each label travels with its own fit."""
    return (
        df.filter(F.col("name") == parameter)
        .join(configs, fit)
        .select("config", "label", "name", "central", "sig_hi", "sig_lo")
    )


def impact_across_configs(
    df: DataFrame, configs: DataFrame, parameters: Sequence[str], fit: str = "fit", sort: bool = False
) -> DataFrame:
    """Impacts of some nuisance parameters across a ``(config, label, fit)`` table, as bars.

    ``configs`` may carry one row per generator version and configuration. The
    rows per parameter are bounded by the configurations.
    """
    rows = with_post_max(df.filter(F.col("name").isin(*parameters)).join(configs, fit))
    order = [F.col("post_max")] if sort else []
    position = F.row_number().over(Window.partitionBy("name").orderBy(*order, "config")) - 1
    return rows.select(
        "config",
        F.concat_ws(" ", "label", prettify_label(F.col("name"))).alias("label"),
        "name",
        "central",
        "sig_hi",
        "sig_lo",
        *IMPACTS,
        "post_max",
        *[F.least(F.col(c), F.lit(0.0)).alias(f"{c}_left") for c in IMPACTS],
        position.alias("ys"),
    )


# --- tables ---------------------------------------------------------------------


def grouped_impact_table(impacts: DataFrame, descending: bool = False, fit: str = "fit") -> DataFrame:
    """``fit, position, name, impact`` in percent, by name or by falling impact inside each fit.

    A fit has one row per group of systematics, so its window is short however many fits there are.
    """
    order = [F.col("avg").desc(), F.col("name")] if descending else [F.lower("name"), F.col("name")]
    position = F.row_number().over(Window.partitionBy(fit).orderBy(*order, "avg")) - 1
    table = impacts.select(fit, position.alias("position"), "name", (100.0 * F.bround("avg", 3)).alias("impact"))
    return table.orderBy(fit, "position")


def pulls_by_category(params: DataFrame, systematics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Fit parameters that have systematic metadata ``(name, category, title)``, one row each with its
    category: a category is a key of the rows, never one gathered list."""
    return params.join(systematics, "name").select(
        "category",
        "name",
        "title",
        F.col("central").alias("mean"),
        F.col("sig_hi").alias("plus"),
        F.col("sig_lo").alias("minus"),
        *keep,
    )
