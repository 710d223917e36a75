"""Weighted histograms as long tables ``(keys..., bin, lo, hi, count, err)``.

Binning happens in the scan stage, sums are pre-aggregated map-side, and the
only thing shuffled is one partial row per task, key and bin. Densifying,
normalising and comparing work on that small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import config
from evq.functions.binning import bin_index, edge_columns, edges_and_centers
from evq.functions.regions import analysis_region
from evq.operators.frames import WEIGHT, selection_column

def with_bin(
    df: DataFrame, column: str, bins, range: tuple[float, float] | None = None, flow: bool = False
) -> DataFrame:
    """Add ``bin``, ``lo``, ``hi`` and ``center`` to every row (null outside the range unless ``flow``)."""
    edges, _ = edges_and_centers(bins, range)
    out = df.withColumn("bin", bin_index(F.col(column), bins, range, flow))
    lo, hi = edge_columns(F.col("bin"), edges)
    return out.withColumns({"lo": lo, "hi": hi, "center": (lo + hi) * 0.5})


def uniform_bins(hist: DataFrame) -> DataFrame:
    """Re-edge so that bin k spans k + 0.5 to k + 1.5."""
    return hist.withColumns({"lo": F.col("bin") + F.lit(0.5), "hi": F.col("bin") + F.lit(1.5)})


def _sums(weight: Column | None) -> list[Column]:
    if weight is None:
        n = F.count(F.lit(1)).cast("double")
        return [n.alias("count"), F.sqrt(n).alias("err")]
    return [F.sum(weight).alias("count"), F.sqrt(F.sum(weight * weight)).alias("err")]


def densify(hist: DataFrame, keys: Sequence[str], n: Column | int, values: Sequence[str]) -> DataFrame:
    """Add the empty bins of every key as zeros. At most ``n`` rows of a key are gathered."""
    filled = hist.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct(*values))))
        ).alias("_m")
    )
    n = F.lit(n) if isinstance(n, int) else n
    rows = filled.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"), "_m")
    got = F.try_element_at("_m", F.col("bin"))
    return rows.select(*keys, "bin", *[F.coalesce(got.getField(v), F.lit(0.0)).alias(v) for v in values])


def _with_edges(hist: DataFrame, keys: Sequence[str], edges: Sequence[float], values: Sequence[str]) -> DataFrame:
    lo, hi = edge_columns(F.col("bin"), edges)
    return hist.select(*keys, "bin", lo.alias("lo"), hi.alias("hi"), *values)


def weighted_histogram(
    df: DataFrame,
    column: str,
    bins,
    range: tuple[float, float] | None = None,
    weight: str | None = WEIGHT,
    by: Sequence[str] = (),
    flow: bool = False,
) -> DataFrame:
    """Per bin the sum of weights and the root of the sum of squared weights; every bin is present."""
    edges, _ = edges_and_centers(bins, range)
    w = None if weight is None else F.col(weight)
    sums = (
        df.select(*by, bin_index(F.col(column), bins, range, flow).alias("bin"), *([weight] if weight else []))
        .groupBy(*by, "bin")
        .agg(*_sums(w))
    )
    return _with_edges(densify(sums, by, len(edges) - 1, ["count", "err"]), by, edges, ["count", "err"])


def density_histogram(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and errors divided by the total and the bin's width, so that the area is 1; null when the total is 0."""
    bins = F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "count", "err")))
    total = F.aggregate(F.col("_h"), F.lit(0.0), lambda acc, b: acc + b["count"])
    rows = hist.groupBy(*by).agg(bins.alias("_h")).withColumn("_total", total)
    scale = F.col("_total") * (F.col("hi") - F.col("lo"))
    return rows.select(*by, "_total", F.inline("_h")).select(
        *by,
        "bin",
        "lo",
        "hi",
        F.try_divide(F.col("count"), scale).alias("count"),
        F.try_divide(F.col("err"), scale).alias("err"),
    )


def histograms_by_variable(
    df: DataFrame,
    binnings: Sequence[tuple] | DataFrame,
    weight: str | None = WEIGHT,
    by: Sequence[str] = (),
    flow: bool = False,
) -> DataFrame:
    """Histograms of many variables in one scan. ``binnings`` holds ``(var, bins, range)``, or is the table of
    ``with_variable_binning``, which is collected: one row per variable of a region. The bin numbers are
    computed before the rows are unpivoted, so no join with the binning is needed."""
    if isinstance(binnings, DataFrame):
        rows = binnings.select("var", "nbins", "xmin", "xmax").orderBy("var").collect()
        binnings = [(r["var"], r["nbins"], (r["xmin"], r["xmax"])) for r in rows]
    edges = {var: edges_and_centers(bins, rng)[0] for var, bins, rng in binnings}
    entries = F.array(
        *[
            F.struct(F.lit(var).alias("var"), bin_index(F.col(var), bins, rng, flow).alias("bin"))
            for var, bins, rng in binnings
        ]
    )
    w = None if weight is None else F.col(weight)
    sums = (
        df.select(*by, *([weight] if weight else []), F.inline(entries)).groupBy(*by, "var", "bin").agg(*_sums(w))
    )
    table = F.create_map(*[x for var, e in edges.items() for x in (F.lit(var), F.array(*map(F.lit, e)))])
    keys = [*by, "var"]
    out = densify(sums, keys, F.size(F.try_element_at(table, F.col("var"))) - 1, ["count", "err"])
    own = F.try_element_at(table, F.col("var"))
    return out.select(
        *keys,
        "bin",
        F.element_at(own, F.col("bin") + 1).alias("lo"),
        F.element_at(own, F.col("bin") + 2).alias("hi"),
        "count",
        "err",
    )


def systematic_templates(
    df: DataFrame,
    column: str,
    bins,
    range: tuple[float, float] | None = None,
    weights: Sequence[str] | None = None,
    flow: bool = True,
) -> DataFrame:
    """Histogram under the nominal and every systematic weight, in one pass: ``weight, bin, ...``."""
    if weights is None:
        weights = [WEIGHT] + [c for c in df.columns if "weight_sys" in c]
    edges, _ = edges_and_centers(bins, range)
    wide = (
        df.select(bin_index(F.col(column), bins, range, flow).alias("bin"), *weights)
        .groupBy("bin")
        .agg(*[F.struct(*_sums(F.col(w))).alias(w) for w in weights])
    )
    long = wide.select(
        "bin",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(w).alias("weight"), F.col(w)["count"].alias("count"), F.col(w)["err"].alias("err"))
                    for w in weights
                ]
            )
        ),
    )
    dense = densify(long, ["weight"], len(edges) - 1, ["count", "err"])
    return _with_edges(dense, ["weight"], edges, ["count", "err"])


def shape_comparison(
    df: DataFrame, binnings: Sequence[tuple], weight: str = "weight", label: str = "label"
) -> DataFrame:
    """Unit-area shapes of signal and background per variable (flow included), and their ratio."""
    hist = histograms_by_variable(df, binnings, weight, [label], flow=True)
    shapes = density_histogram(hist, [label, "var"])

    def of(value, name):
        return F.max(F.when(F.col(label) == value, F.col(name)))

    return (
        shapes.groupBy("var", "bin", "lo", "hi")
        .agg(
            of(1, "count").alias("signal"),
            of(1, "err").alias("signal_err"),
            of(0, "count").alias("background"),
            of(0, "err").alias("background_err"),
        )
        .withColumn("ratio", F.try_divide("signal", "background"))
    )


def data_mc_stack(
    df: DataFrame,
    column: str,
    bins,
    range: tuple[float, float] | None = None,
    processes: Sequence[str] = ("tW_DR", "ttbar", "Zjets", "Diboson", "MCNP"),
    weight: str = WEIGHT,
    process: str = "process",
    lumi: float | None = None,
    combine_minor: bool = False,
    flow: bool = True,
) -> DataFrame:
    """Data (unweighted) against the stacked prediction (weight times luminosity), with the ratio and its error."""
    scale = config.LUMI if lumi is None else lumi
    edges, _ = edges_and_centers(bins, range)
    name = F.col(process)
    w = F.when(name == "Data", 1.0).when(name.isin(*processes), F.col(weight) * F.lit(scale))
    stacks = {p: [p] for p in processes}
    if combine_minor:
        stacks = {p: [p] for p in processes if p not in config.MINOR_BACKGROUNDS}
        stacks["minor"] = [p for p in processes if p in config.MINOR_BACKGROUNDS]

    def total(members):
        return F.coalesce(F.sum(F.when(name.isin(*members), F.col("_w"))), F.lit(0.0))

    def error(members):
        return F.sqrt(F.coalesce(F.sum(F.when(name.isin(*members), F.col("_w") * F.col("_w"))), F.lit(0.0)))

    sums = {
        "data": total(["Data"]),
        "data_err": error(["Data"]),
        "mc": total(processes),
        "mc_err": error(processes),
        **{f"n_{stack}": total(members) for stack, members in stacks.items()},
    }
    hist = (
        df.select(bin_index(F.col(column), bins, range, flow).alias("bin"), process, w.alias("_w"))
        .filter(F.col("_w").isNotNull())
        .groupBy("bin")
        .agg(*[c.alias(n) for n, c in sums.items()])
    )
    values = list(sums)
    dense = _with_edges(densify(hist, [], len(edges) - 1, values), [], edges, values)
    return with_ratio(dense)


def with_ratio(hist: DataFrame) -> DataFrame:
    """Add ``ratio = data / mc`` and its propagated error to a table of data and mc counts."""
    data, mc, mc_err = F.col("data"), F.col("mc"), F.col("mc_err")
    square = mc * mc
    spread = F.try_divide(data * mc_err, square)
    return hist.withColumns(
        {
            "ratio": F.try_divide(data, mc),
            "ratio_err": F.sqrt(F.try_divide(data, square) + spread * spread),
        }
    )


def uncertainty_band(
    hist: DataFrame, mc: str = "mc", lo: str = "err_lo", hi: str = "err_hi", threshold: float = 0.25
) -> DataFrame:
    """Band ``mc - lo .. mc + hi`` and the same relative to ``mc``; all 0 where ``mc`` is below the threshold."""
    empty = F.col(mc) < threshold

    def kept(value):
        return F.when(empty, 0.0).otherwise(value)

    return hist.withColumns(
        {
            "band_lo": kept(F.col(mc) - F.col(lo)),
            "band_hi": kept(F.col(mc) + F.col(hi)),
            "ratio_lo": kept(1.0 - F.try_divide(lo, mc)),
            "ratio_hi": kept(1.0 + F.try_divide(hi, mc)),
        }
    )


def signal_over_background(
    df: DataFrame,
    selections: Mapping[str, str],
    signal: Sequence[str] = ("tW_DR",),
    background: Sequence[str] = ("ttbar", "Diboson", "Zjets", "MCNP"),
    process: str = "process",
    weight: str = WEIGHT,
    use_tptrw: bool = True,
) -> DataFrame:
    """Sum of signal over sum of background weights for each named selection, in one scan."""
    is_signal, is_background = F.col(process).isin(*signal), F.col(process).isin(*background)
    passes = {name: selection_column(df, text) for name, text in selections.items()}
    corrected = F.col(weight) * F.col("weight_tptrw_tool") if use_tptrw else F.col(weight)
    base = df.withColumns(
        {
            "_pass": F.struct(*[p.alias(n) for n, p in passes.items()]),
            "_sig": F.when(is_signal, F.col(weight)),
            "_bkg": F.when(is_background, corrected),
        }
    )
    sums = base.filter(is_signal | is_background).agg(
        *[
            F.struct(
                F.lit(n).alias("selection"),
                F.sum(F.when(F.col("_pass")[n], F.col("_sig"))).alias("signal"),
                F.sum(F.when(F.col("_pass")[n], F.col("_bkg"))).alias("background"),
            ).alias(f"_{i}")
            for i, n in enumerate(passes)
        ]
    )
    return sums.select(F.inline(F.array(*sums.columns))).withColumn("s_over_b", F.try_divide("signal", "background"))


def region_yields(
    df: DataFrame, region: str = "region", process: str = "process", weight: str = WEIGHT
) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(region, process).agg(
        F.sum(w).alias("yield"), F.sqrt(F.sum(w * w)).alias("err"), F.count(F.lit(1)).alias("events")
    )


def region_yield_totals(
    df: DataFrame, region: str = "region", process: str = "process", weight: str = WEIGHT
) -> DataFrame:
    """Yields with the totals of each region and of all regions, marked by ``level``: 0 process, 1 region, 2 all."""
    w = F.col(weight)
    return df.rollup(region, process).agg(
        F.sum(w).alias("yield"),
        F.sqrt(F.sum(w * w)).alias("err"),
        F.count(F.lit(1)).alias("events"),
        (F.grouping(region) + F.grouping(process)).cast("int").alias("level"),
    )


def two_sample_templates(
    df: DataFrame,
    column: str,
    samples: tuple[str, str] = ("tW_DR", "tW_DS"),
    sample: str = "sample_group",
    weight: str = WEIGHT,
    lumi: float | None = None,
    binning: Mapping[str, tuple[int, float, float]] | None = None,
    kept: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Response templates of two samples in the three regions (own binning each, flow included), their
    one-sided comparison, and whether the bin's centre lies in the excluded response range.

    One scan: an event is in at most one region, so its bin number follows from its region.
    """
    binning = {analysis_region(r): b for r, b in (binning or config.TEMPLATE_BINNING).items()}
    kept = kept or config.TEMPLATE_KEPT
    scale = config.LUMI if lumi is None else lumi
    number, edges = F.lit(None).cast("int"), {}
    region_name = F.lit(None).cast("string")
    for region, (n, lo, hi) in binning.items():
        chosen = selection_column(df, config.SELECTIONS[region])
        number = F.when(chosen, bin_index(F.col(column), n, (lo, hi), flow=True)).otherwise(number)
        region_name = F.when(chosen, F.lit(region)).otherwise(region_name)
        edges[region] = edges_and_centers(n, (lo, hi))[0]
    w = F.col(weight) * F.lit(scale)
    wide = (
        df.filter(F.col(sample).isin(*samples))
        .select(region_name.alias("region"), number.alias("bin"), sample, w.alias("_w"))
        .filter(F.col("region").isNotNull())
        .groupBy("region", "bin")
        .agg(
            *[
                agg
                for i, s in enumerate(samples, 1)
                for agg in (
                    F.coalesce(F.sum(F.when(F.col(sample) == s, F.col("_w"))), F.lit(0.0)).alias(f"count{i}"),
                    F.sqrt(
                        F.coalesce(F.sum(F.when(F.col(sample) == s, F.col("_w") * F.col("_w"))), F.lit(0.0))
                    ).alias(f"err{i}"),
                )
            ]
        )
    )
    values = ["count1", "err1", "count2", "err2"]
    table = F.create_map(*[x for r, e in edges.items() for x in (F.lit(r), F.array(*map(F.lit, e)))])
    own = F.try_element_at(table, F.col("region"))
    dense = densify(wide, ["region"], F.size(own) - 1, values).withColumns(
        {"lo": F.element_at(own, F.col("bin") + 1), "hi": F.element_at(own, F.col("bin") + 2)}
    )
    center = (F.col("lo") + F.col("hi")) * 0.5
    excluded = F.lit(False)
    for region, (low, high) in kept.items():
        here = F.col("region") == region
        if low is not None:
            excluded = excluded | (here & (center < low))
        if high is not None:
            excluded = excluded | (here & (center > high))
    change = F.try_divide(F.col("count2") - F.col("count1"), F.col("count1")) * 100.0
    return dense.select(
        "region", "bin", "lo", "hi", *values, change.alias("percent_up"), (-change).alias("percent_down"),
        excluded.alias("excluded"),
    )
