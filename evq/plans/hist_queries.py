"""Queries over histograms, feature statistics and binned comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.regions import features_for
from evq.functions.stats import chi2_prob, kolmogorov_prob
from evq.operators import compare, features, frames, hist
from evq.plans.catalog import bin_sql, edge_sql, query, rounded
from evq.plans.views import EVENT_SQL, WIDE_SQL, events, table, wide_events

EV = f"WITH ev AS ({EVENT_SQL})"
WD = f"WITH ev AS ({WIDE_SQL})"
KEY = "event_id"
MASS = (25, 0.0, 200.0)
PT = (20, 10.0, 90.0)
EDGES = [0.0, 5.0, 10.0, 25.0, 60.0, 100.0]


def _dense(source: str, n: int, lo: float, hi: float, values: str, by: str = "") -> str:
    """All bins of every key of a ``h(by..., bin, count, err)`` table, rounded."""
    keys = f"(SELECT DISTINCT {by} FROM {source}) k, " if by else ""
    match = " AND ".join(["h.bin = b.bin", *[f"h.{k.strip()} IS NOT DISTINCT FROM k.{k.strip()}" for k in by.split(",") if k]])
    shown = "".join(f"k.{k.strip()}, " for k in by.split(",") if k)
    return f"""SELECT {shown}b.bin, {edge_sql(n, lo, hi, 'b.bin')}, {values}
      FROM {keys}(SELECT CAST(range AS INT) AS bin FROM range({n})) b LEFT JOIN {source} h ON {match}"""


_ROUNDED = "round(coalesce(h.count, 0), 6) AS count, round(coalesce(h.err, 0), 6) AS err"


def _hist_sql(x: str, binning, weight: str, by: str = "", flow: bool = False, where: str = "true") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}{bin_sql(x, *binning, flow)} AS bin, sum({weight}) AS count,
      sqrt(sum({weight} * {weight})) AS err FROM ev WHERE {where} GROUP BY ALL"""


@query(
    "with_bin",
    f"""{EV}, t AS (SELECT event_id, mass_lep1jet1, {bin_sql('mass_lep1jet1', *MASS)} AS bin FROM ev),
    e AS (SELECT *, {edge_sql(*MASS)} FROM t)
    SELECT event_id, mass_lep1jet1, bin, CASE WHEN bin IS NOT NULL THEN lo END AS lo,
      CASE WHEN bin IS NOT NULL THEN hi END AS hi, (lo + hi) * 0.5 AS center FROM e""",
)
def _(spark, sf):
    return hist.with_bin(events(spark, sf).select(KEY, "mass_lep1jet1"), "mass_lep1jet1", MASS[0], MASS[1:])


@query(
    "with_bin_edges",
    f"""{EV}, e AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 25.0), (3, 25.0, 60.0), (4, 60.0, 100.0))
      AS e(bin, lo, hi))
    SELECT event_id, pT_lep1, CAST(e.bin AS INT) AS bin, e.lo::DOUBLE AS lo, e.hi::DOUBLE AS hi, ((e.lo + e.hi) / 2)::DOUBLE AS center
    FROM ev LEFT JOIN e ON pT_lep1 >= e.lo AND (pT_lep1 < e.hi OR (e.bin = 4 AND pT_lep1 = e.hi))""",
)
def _(spark, sf):
    return hist.with_bin(events(spark, sf).select(KEY, "pT_lep1"), "pT_lep1", EDGES)


@query(
    "weighted_histogram",
    f"""{EV}, h AS ({_hist_sql('mass_lep1jet1', MASS, 'weight_nominal', 'process', flow=True)})
    {_dense('h', *MASS, _ROUNDED, 'process')}""",
)
def _(spark, sf):
    h = hist.weighted_histogram(events(spark, sf), "mass_lep1jet1", MASS[0], MASS[1:], by=["process"], flow=True)
    return rounded(h, 6, "count", "err")


@query(
    "weighted_histogram_counts",
    f"""{EV}, h AS (SELECT {bin_sql('pT_lep1', *PT)} AS bin, count(*)::DOUBLE AS count, sqrt(count(*)) AS err FROM ev GROUP BY 1)
    {_dense('h', *PT, _ROUNDED)}""",
)
def _(spark, sf):
    h = hist.weighted_histogram(events(spark, sf), "pT_lep1", PT[0], PT[1:], weight=None)
    return rounded(h, 6, "count", "err")


@query(
    "uniform_bins",
    f"""{EV}, e AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 25.0), (3, 25.0, 60.0), (4, 60.0, 100.0))
      AS e(bin, low, high))
    SELECT CAST(e.bin AS INT) AS bin, e.bin + 0.5::DOUBLE AS lo, e.bin + 1.5::DOUBLE AS hi,
      round(coalesce(sum(weight_nominal), 0), 6) AS count, round(coalesce(sqrt(sum(weight_nominal * weight_nominal)), 0), 6) AS err
    FROM e LEFT JOIN ev ON pT_lep1 >= e.low AND (pT_lep1 < e.high OR (e.bin = 4 AND pT_lep1 = e.high)) GROUP BY e.bin""",
)
def _(spark, sf):
    return rounded(hist.uniform_bins(hist.weighted_histogram(events(spark, sf), "pT_lep1", EDGES)), 6, "count", "err")


@query(
    "density_histogram",
    f"""{EV}, h AS ({_hist_sql('mass_lep1jet1', MASS, 'weight_nominal', 'label', flow=True)}),
    d AS ({_dense('h', *MASS, 'coalesce(h.count, 0) AS c, coalesce(h.err, 0) AS e', 'label')}),
    a AS (SELECT label, sum(c * (hi - lo)) AS area FROM d GROUP BY label)
    SELECT label, bin, lo, hi, round(c / nullif(area, 0), 9) AS count, round(e / nullif(area, 0), 9) AS err
    FROM d JOIN a USING (label)""",
)
def _(spark, sf):
    h = hist.weighted_histogram(events(spark, sf), "mass_lep1jet1", MASS[0], MASS[1:], by=["label"], flow=True)
    return rounded(hist.density_histogram(h, ["label"]), 9, "count", "err")


_VARIABLES = [("mass_lep1jet1", 25, (0.0, 200.0)), ("pT_lep1", 20, (10.0, 90.0)), ("pT_jet2", 10, (0.0, 80.0))]


def _by_variable(values: str, weight: str, by: str, flow: bool) -> str:
    parts = []
    for i, (var, n, (lo, hi)) in enumerate(_VARIABLES):
        parts.append(f"h{i} AS ({_hist_sql(var, (n, lo, hi), weight, by, flow)})")
    rows = [
        "SELECT '{}' AS var, t.* FROM ({}) t".format(var, _dense(f"h{i}", n, lo, hi, values, by))
        for i, (var, n, (lo, hi)) in enumerate(_VARIABLES)
    ]
    return ", ".join(parts) + ", d AS (" + " UNION ALL ".join(rows) + ")"


@query(
    "histograms_by_variable",
    f"{EV}, {_by_variable(_ROUNDED, 'weight_nominal', 'label', False)} SELECT * FROM d",
)
def _(spark, sf):
    h = hist.histograms_by_variable(events(spark, sf), _VARIABLES, by=["label"])
    return rounded(h, 6, "count", "err")


@query(
    "histograms_by_variable_table",
    f"{EV}, {_by_variable(_ROUNDED, 'weight_nominal', 'label', False)} SELECT * FROM d",
)
def _(spark, sf):
    rows = [("2j2b", var, bins, lo, hi) for var, bins, (lo, hi) in _VARIABLES] + [("1j1b", "pT_lep1", 7, 0.0, 1.0)]
    df = events(spark, sf)
    binning = frames.with_variable_binning(df, spark.createDataFrame(rows, "region string, var string, nbins int, xmin double, xmax double"), "2j2b")
    return rounded(hist.histograms_by_variable(df, binning, by=["label"]), 6, "count", "err")


_SYSTEMATICS = ["weight_nominal", "weight_sys_pileup_UP", "weight_sys_pileup_DOWN", "weight_sys_noreweight"]


@query(
    "systematic_templates",
    f"{EV}, "
    + ", ".join(f"s{i} AS ({_hist_sql('mass_lep1jet1', MASS, w, flow=True)})" for i, w in enumerate(_SYSTEMATICS))
    + " "
    + " UNION ALL ".join(
        "SELECT '{}' AS weight, t.* FROM ({}) t".format(w, _dense(f"s{i}", *MASS, _ROUNDED))
        for i, w in enumerate(_SYSTEMATICS)
    ),
)
def _(spark, sf):
    h = hist.systematic_templates(events(spark, sf), "mass_lep1jet1", MASS[0], MASS[1:])
    return rounded(h, 6, "count", "err")


@query(
    "shape_comparison",
    f"""WITH raw AS ({EVENT_SQL}), ev AS (SELECT *, CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS weight FROM raw),
    {_by_variable('coalesce(h.count, 0) AS c, coalesce(h.err, 0) AS e', 'weight', 'label', True)},
    a AS (SELECT var, label, sum(c * (hi - lo)) AS area FROM d GROUP BY ALL),
    p AS (SELECT d.*, c / nullif(area, 0) AS dens, e / nullif(area, 0) AS derr FROM d JOIN a USING (var, label)),
    q AS (SELECT var, bin, max(lo) AS lo, max(hi) AS hi, max(dens) FILTER (label = 1) AS signal, max(derr) FILTER (label = 1) AS signal_err,
      max(dens) FILTER (label = 0) AS background, max(derr) FILTER (label = 0) AS background_err FROM p GROUP BY var, bin)
    SELECT var, bin, lo, hi, round(signal, 9) AS signal, round(signal_err, 9) AS signal_err, round(background, 9) AS background,
      round(background_err, 9) AS background_err, round(signal / nullif(background, 0), 9) AS ratio FROM q""",
)
def _(spark, sf):
    df = events(spark, sf).withColumn("weight", frames.clipped("weight_nominal"))
    shapes = hist.shape_comparison(df, _VARIABLES)
    return rounded(shapes, 9, "signal", "signal_err", "background", "background_err", "ratio")


_STACK = ["tW_DR", "ttbar", "Zjets", "Diboson", "MCNP"]


def _sum_where(condition: str, power: str = "") -> str:
    total = f"coalesce(sum(w{power}) FILTER ({condition}), 0)"
    return f"sqrt({total})" if power else total


def _stack_sql(stacks: dict[str, str], where: str) -> str:
    columns = {
        "data": _sum_where("process = 'Data'"),
        "data_err": _sum_where("process = 'Data'", " * w"),
        "mc": _sum_where("process <> 'Data'"),
        "mc_err": _sum_where("process <> 'Data'", " * w"),
        **{f"n_{s}": _sum_where(c) for s, c in stacks.items()},
    }
    aggregates = ", ".join(f"{c} AS {n}" for n, c in columns.items())
    filled = ", ".join(f"coalesce(h.{n}, 0) AS {n}" for n in columns)
    shown = ", ".join(f"round({n}, 5) AS {n}" for n in columns)
    return f"""{EV}, t AS (SELECT {bin_sql('mass_lep1jet1', *MASS, True)} AS bin, process,
        CASE WHEN process = 'Data' THEN 1.0::DOUBLE ELSE weight_nominal * 139.0 END AS w FROM ev WHERE {where}),
      h AS (SELECT bin, {aggregates} FROM t GROUP BY bin), d AS ({_dense('h', *MASS, filled)})
      SELECT bin, lo, hi, {shown}, round(data / nullif(mc, 0), 6) AS ratio,
        round(sqrt(data / nullif(mc * mc, 0) + pow(data * mc_err / nullif(mc * mc, 0), 2)), 6) AS ratio_err FROM d"""


def _stack_rounded(df):
    counts = [c for c in df.columns if c not in ("bin", "lo", "hi", "ratio", "ratio_err")]
    return rounded(rounded(df, 5, *counts), 6, "ratio", "ratio_err")


@query("data_mc_stack", _stack_sql({p: f"process = '{p}'" for p in _STACK}, "reg2j2b AND OS = 1"))
def _(spark, sf):
    df = frames.select_region(events(spark, sf), "2j2b")
    return _stack_rounded(hist.data_mc_stack(df, "mass_lep1jet1", MASS[0], MASS[1:]))


@query(
    "data_mc_stack_combined",
    _stack_sql(
        {
            "tW_DR": "process = 'tW_DR'",
            "ttbar": "process = 'ttbar'",
            "minor": "process IN ('Zjets', 'Diboson', 'MCNP')",
        },
        "true",
    ),
)
def _(spark, sf):
    return _stack_rounded(
        hist.data_mc_stack(events(spark, sf), "mass_lep1jet1", MASS[0], MASS[1:], combine_minor=True)
    )


@query(
    "uncertainty_band",
    f"""{EV}, h AS ({_hist_sql('pT_lep1', PT, 'weight_nominal')}), d AS ({_dense('h', *PT, 'coalesce(h.count, 0) AS mc, coalesce(h.err, 0) AS err_lo, coalesce(h.err, 0) * 1.5 AS err_hi')})
    SELECT bin, round(mc, 6) AS mc,
      round(CASE WHEN mc < 0.25 THEN 0 ELSE mc - err_lo END, 6) AS band_lo, round(CASE WHEN mc < 0.25 THEN 0 ELSE mc + err_hi END, 6) AS band_hi,
      round(CASE WHEN mc < 0.25 THEN 0 ELSE 1 - err_lo / nullif(mc, 0) END, 6) AS ratio_lo,
      round(CASE WHEN mc < 0.25 THEN 0 ELSE 1 + err_hi / nullif(mc, 0) END, 6) AS ratio_hi FROM d""",
)
def _(spark, sf):
    h = hist.weighted_histogram(events(spark, sf), "pT_lep1", PT[0], PT[1:])
    table_ = h.select("bin", F.col("count").alias("mc"), F.col("err").alias("err_lo"), (F.col("err") * 1.5).alias("err_hi"))
    band = hist.uncertainty_band(table_).drop("err_lo", "err_hi")
    return rounded(band, 6, "mc", "band_lo", "band_hi", "ratio_lo", "ratio_hi")


_NAMED = {
    "r1j1b": "(reg1j1b == True) & (OS == True)",
    "r2j1b": "(reg2j1b == True) & (OS == True)",
    "r2j2b_low": "reg2j2b == 1 && OS == 1 && mass_lep1jet1 < 155",
}
_NAMED_SQL = {
    "r1j1b": "reg1j1b AND OS = 1",
    "r2j1b": "reg2j1b AND OS = 1",
    "r2j2b_low": "reg2j2b AND OS = 1 AND mass_lep1jet1 < 155",
}


@query(
    "signal_over_background",
    f"{EV} "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS selection, round(sum(weight_nominal) FILTER (process = 'tW_DR'), 6) AS signal,
        round(sum(weight_nominal * weight_tptrw_tool) FILTER (process IN ('ttbar', 'Diboson', 'Zjets', 'MCNP')), 6) AS background,
        round(sum(weight_nominal) FILTER (process = 'tW_DR')
          / sum(weight_nominal * weight_tptrw_tool) FILTER (process IN ('ttbar', 'Diboson', 'Zjets', 'MCNP')), 9) AS s_over_b
        FROM ev WHERE {c}"""
        for n, c in _NAMED_SQL.items()
    ),
)
def _(spark, sf):
    return rounded(
        rounded(hist.signal_over_background(events(spark, sf), _NAMED), 6, "signal", "background"), 9, "s_over_b"
    )


@query(
    "region_yields",
    f"""{EV} SELECT CASE WHEN reg1j1b THEN '1j1b' WHEN reg2j1b THEN '2j1b' WHEN reg2j2b THEN '2j2b' END AS region, process,
      round(sum(weight_nominal), 6) AS yield, round(sqrt(sum(weight_nominal * weight_nominal)), 6) AS err, count(*) AS events
    FROM ev GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(hist.region_yields(frames.add_region(events(spark, sf))), 6, "yield", "err")


@query(
    "region_yield_totals",
    f"""{EV}, r AS (SELECT CASE WHEN reg1j1b THEN '1j1b' WHEN reg2j1b THEN '2j1b' WHEN reg2j2b THEN '2j2b' END AS region, process, weight_nominal AS w FROM ev)
    SELECT region, process, round(sum(w), 6) AS yield, round(sqrt(sum(w * w)), 6) AS err, count(*) AS events,
      CAST(grouping(region) + grouping(process) AS INT) AS level FROM r GROUP BY ROLLUP (region, process)""",
)
def _(spark, sf):
    return rounded(hist.region_yield_totals(frames.add_region(events(spark, sf))), 6, "yield", "err")


def _templates_sql() -> str:
    parts, rows = [], []
    for i, (region, (n, lo, hi), cut) in enumerate(
        [
            ("1j1b", (18, 0.2, 0.75), "c < 0.35"),
            ("2j1b", (18, 0.2, 0.85), "c > 0.7"),
            ("2j2b", (18, 0.2, 0.9), "c < 0.45 OR c > 0.775"),
        ]
    ):
        parts.append(
            f"""h{i} AS (SELECT {bin_sql('score', n, lo, hi, True)} AS bin,
            coalesce(sum(w) FILTER (sample_group = 'tW_DR'), 0) AS count1, sqrt(coalesce(sum(w * w) FILTER (sample_group = 'tW_DR'), 0)) AS err1,
            coalesce(sum(w) FILTER (sample_group = 'tW_DS'), 0) AS count2, sqrt(coalesce(sum(w * w) FILTER (sample_group = 'tW_DS'), 0)) AS err2
            FROM ev WHERE reg{region} AND OS = 1 GROUP BY 1)"""
        )
        filled = ", ".join(f"coalesce(h.{v}, 0) AS {v}" for v in ("count1", "err1", "count2", "err2"))
        rows.append(
            f"""SELECT '{region}' AS region, bin, lo, hi, count1, err1, count2, err2, {cut} AS excluded
            FROM (SELECT *, (lo + hi) / 2 AS c FROM ({_dense(f'h{i}', n, lo, hi, filled)}))"""
        )
    return f"""WITH raw AS ({EVENT_SQL}), ev AS (SELECT *, weight_nominal * 139.0 AS w FROM raw WHERE sample_group IN ('tW_DR', 'tW_DS')),
      {', '.join(parts)}, d AS ({' UNION ALL '.join(rows)})
      SELECT region, bin, round(lo, 9) AS lo, round(hi, 9) AS hi, round(count1, 5) AS count1, round(err1, 5) AS err1, round(count2, 5) AS count2,
        round(err2, 5) AS err2, round((count2 - count1) / nullif(count1, 0) * 100, 6) AS percent_up,
        round(-(count2 - count1) / nullif(count1, 0) * 100, 6) AS percent_down, excluded FROM d"""


@query("two_sample_templates", _templates_sql())
def _(spark, sf):
    out = hist.two_sample_templates(events(spark, sf), "score")
    out = rounded(out, 5, "count1", "err1", "count2", "err2")
    return rounded(rounded(out, 9, "lo", "hi"), 6, "percent_up", "percent_down")


# --- feature statistics ---------------------------------------------------------

_STATISTICS = ["E_jet1", "const_feature", "mass_lep1jet1", "pT_jet2", "pT_lep1", "pTsys_lep1lep2"]


@query(
    "constant_columns",
    f"{EV} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, min({c}) AS value FROM ev HAVING count(DISTINCT {c}) = 1" for c in _STATISTICS
    ),
)
def _(spark, sf):
    return features.constant_columns(events(spark, sf), _STATISTICS)


_CORRELATED = ["E_jet1", "const_feature", "mass_lep1jet1", "pT_jet2", "pT_lep1", "pTsys_lep1lep2"]
_WIDE = list(dict.fromkeys([*features_for("ALL"), "weight_nominal", "weight_tptrw_tool", "weight_trrw_tool", "weight_campaign", "score", "const_feature"]))


def _corr_sql(columns: list[str], source: str) -> str:
    """All coefficients in one aggregate, then one row each; null where a column does not vary."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    value = "CASE WHEN min({0}) < max({0}) AND min({1}) < max({1}) THEN round(corr({0}, {1}), 9) END AS c{2}_{3}"
    row = ", ".join(value.format(columns[i], columns[j], i, j) for i, j in pairs)
    return f"SELECT unnest([{', '.join(f"{{'pos_a': {i}, 'feature_a': '{columns[i]}', 'pos_b': {j}, 'feature_b': '{columns[j]}', 'coeff': c{i}_{j}}}" for i, j in pairs)}], recursive := true) FROM (SELECT {row} FROM {source})"


_CORR_SQL = _corr_sql(_CORRELATED, "ev")


@query("correlation_matrix", f"{EV} {_CORR_SQL}")
def _(spark, sf):
    return rounded(features.correlation_matrix(events(spark, sf), _CORRELATED), 9, "coeff")


@query("correlation_matrix_products", f"WITH w AS ({WIDE_SQL}) {_corr_sql(_WIDE, 'w')}")
def _(spark, sf):
    return rounded(features.correlation_matrix(wide_events(spark, sf), _WIDE), 9, "coeff")


@query(
    "correlated_pairs",
    f"{EV}, c AS ({_CORR_SQL}) SELECT feature_b AS drop_this, feature_a AS because, coeff FROM c WHERE abs(coeff) > 0.85",
)
def _(spark, sf):
    matrix = features.correlation_matrix(events(spark, sf), _CORRELATED)
    return rounded(features.correlated_pairs(matrix), 9, "coeff")


_IMPORTANCE_SQL = "SELECT concat('NP_', l_partkey) AS feature, round(avg(l_quantity), 9) AS importance FROM lineitem GROUP BY l_partkey"
_PAIRS_SQL = """SELECT DISTINCT concat('NP_', l_partkey) AS drop_this, concat('NP_', l_suppkey) AS because
  FROM lineitem WHERE l_partkey <> l_suppkey"""


@query(
    "feature_candidates",
    f"""WITH i AS ({_IMPORTANCE_SQL}), p AS ({_PAIRS_SQL}),
    top AS (SELECT * FROM i ORDER BY importance DESC, feature LIMIT 20),
    won AS (SELECT t.feature, p.because FROM top t JOIN p ON p.drop_this = t.feature JOIN i o ON o.feature = p.because
      WHERE t.importance > o.importance OR (t.importance = o.importance AND t.feature < o.feature))
    SELECT feature, importance FROM top WHERE (feature NOT IN (SELECT drop_this FROM p) OR feature IN (SELECT feature FROM won))
      AND feature NOT IN (SELECT because FROM won)""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    importances = rows.groupBy(F.concat(F.lit("NP_"), "l_partkey").alias("feature")).agg(
        F.round(F.avg("l_quantity"), 9).alias("importance")
    )
    pairs = (
        rows.filter("l_partkey <> l_suppkey")
        .select(
            F.concat(F.lit("NP_"), "l_partkey").alias("drop_this"), F.concat(F.lit("NP_"), "l_suppkey").alias("because")
        )
        .distinct()
    )
    return features.feature_candidates(importances, pairs, 20)


# --- binned comparisons ---------------------------------------------------------


@query(
    "kolmogorov_prob",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice / 14000.0 AS u FROM lineitem),
    s AS (SELECT *, greatest(1, round_even(3.0 / u, 0)) AS n FROM t)
    SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN u < 0.2 THEN 1
      WHEN u < 0.755 THEN 1 - 2.50662827 * (exp(-1.2337005501361697 / (u * u)) + exp(-11.103304951225528 / (u * u)) + exp(-30.842513753404244 / (u * u))) / u
      WHEN u < 6.8116 THEN 2 * (exp(-2 * u * u) - CASE WHEN n >= 2 THEN exp(-8 * u * u) ELSE 0 END
        + CASE WHEN n >= 3 THEN exp(-18 * u * u) ELSE 0 END - CASE WHEN n >= 4 THEN exp(-32 * u * u) ELSE 0 END)
      ELSE 0 END, 9) AS p FROM s""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    p = kolmogorov_prob(F.col("l_extendedprice") / 14000.0)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(p, 9).alias("p"))


_PAIR_SQL = f"""h AS ({_hist_sql('mass_lep1jet1', MASS, 'weight', 'region, label', True)}),
    pairs AS (SELECT region, bin, coalesce(max(count) FILTER (label = 1), 0) AS h1, coalesce(max(err) FILTER (label = 1), 0) AS e1,
      coalesce(max(count) FILTER (label = 0), 0) AS h2, coalesce(max(err) FILTER (label = 0), 0) AS e2 FROM h GROUP BY region, bin)"""
_PAIR_EV = f"""WITH raw AS ({EVENT_SQL}), ev AS (SELECT *, CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS weight,
    CASE WHEN reg1j1b THEN '1j1b' WHEN reg2j1b THEN '2j1b' WHEN reg2j2b THEN '2j2b' END AS region FROM raw), {_PAIR_SQL}"""


def _pairs(spark, sf):
    df = frames.add_region(events(spark, sf)).withColumn("weight", frames.clipped("weight_nominal"))
    h = hist.weighted_histogram(df, "mass_lep1jet1", MASS[0], MASS[1:], "weight", ["region", "label"], flow=True)
    return compare.pair_by(h, "label", 1, 0, ["region"])


_KS_TAIL = """k AS (SELECT region, max(d) AS ks_stat, any_value(z) AS z FROM df GROUP BY region)
    SELECT region, round(ks_stat, 9) AS ks_stat, round(ks_stat * z, 9) AS ks_z FROM k"""
_KS_SUMS = """s AS (SELECT region, sum(h1) AS s1, sum(h2) AS s2, sum(h1) * sum(h1) / sum(e1 * e1) AS n1,
    sum(h2) * sum(h2) / sum(e2 * e2) AS n2 FROM pairs GROUP BY region)"""


@query(
    "ks_two_sample",
    f"""{_PAIR_EV}, {_KS_SUMS}, df AS (SELECT p.region, abs(h1 / s1 - h2 / s2) AS d, sqrt(n1 * n2 / (n1 + n2)) AS z
      FROM pairs p JOIN s ON p.region IS NOT DISTINCT FROM s.region), {_KS_TAIL}""",
)
def _(spark, sf):
    return rounded(compare.ks_two_sample(_pairs(spark, sf), ["region"]).drop("ks_pvalue"), 9, "ks_stat", "ks_z")


@query(
    "ks_two_sample_cumulative",
    f"""{_PAIR_EV}, {_KS_SUMS}, df AS (SELECT p.region, abs(sum(h1 / s1 - h2 / s2) OVER (PARTITION BY p.region ORDER BY bin)) AS d,
      sqrt(n1 * n2 / (n1 + n2)) AS z FROM pairs p JOIN s ON p.region IS NOT DISTINCT FROM s.region), {_KS_TAIL}""",
)
def _(spark, sf):
    test = compare.ks_two_sample(_pairs(spark, sf), ["region"], cumulative=True)
    return rounded(test.drop("ks_pvalue"), 9, "ks_stat", "ks_z")


def _chi2_sql(second: str) -> str:
    return f"""{_PAIR_EV}, g AS (SELECT * FROM pairs WHERE h1 <> 0 AND h2 <> 0),
    s AS (SELECT region, sum(h1) AS s1, sum(h2) AS s2 FROM g GROUP BY region)
    SELECT g.region, round(sum(pow(s2 * h1 - s1 * h2, 2) / ({second} * e2 * e2 + s2 * s2 * e1 * e1)), 6) AS chi2,
      CAST(count(*) - 1 AS INT) AS ndf FROM g JOIN s ON g.region IS NOT DISTINCT FROM s.region GROUP BY g.region"""


@query("chi2_two_sample", _chi2_sql("s1 * s2"))
def _(spark, sf):
    return rounded(compare.chi2_two_sample(_pairs(spark, sf), ["region"], with_probability=False), 6, "chi2")


@query("chi2_two_sample_symmetric", _chi2_sql("s1 * s1"))
def _(spark, sf):
    test = compare.chi2_two_sample(_pairs(spark, sf), ["region"], symmetric=True, with_probability=False)
    return rounded(test, 6, "chi2")


# For any number of degrees of freedom: one less the series of the lower incomplete gamma function.
@query(
    "chi2_two_sample_pvalue",
    f"""WITH t AS ({_chi2_sql("s1 * s2")}), u AS (SELECT *, chi2 / 2 AS x, ndf / 2.0::DOUBLE AS a FROM t)
    SELECT region, chi2, ndf, round(CASE WHEN ndf < 1 THEN NULL WHEN x <= 0 THEN 1.0 WHEN x > 2000 THEN 0.0 ELSE
      1 - list_sum(list_transform(range(CAST(2 * x + 200 AS INT)), lambda k: exp((a + k) * ln(x) - x - lgamma(a + k + 1)))) END, 6) AS chi2_pvalue FROM u""",
)
def _(spark, sf):
    return rounded(compare.chi2_two_sample(_pairs(spark, sf), ["region"]), 6, "chi2", "chi2_pvalue")


# An even number of degrees of freedom has a closed form: exp(-x/2) times a partial sum of the exponential series.
@query(
    "chi2_prob",
    """WITH t AS (SELECT l_partkey, avg(l_extendedprice) / 2000.0 AS chi2, 2 * (1 + l_partkey % 20) AS ndf
      FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, ndf, round(exp(-chi2 / 2) * list_sum(list_transform(range(ndf // 2), lambda k: pow(chi2 / 2, k) / gamma(k + 1))), 7)
      AS chi2_pvalue FROM t""",
)
def _(spark, sf):
    tests = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        (F.avg("l_extendedprice") / 2000.0).alias("chi2"), F.expr("2 * (1 + l_partkey % 20)").alias("ndf")
    )
    return tests.select("l_partkey", "ndf", F.round(chi2_prob(F.col("chi2"), F.col("ndf")), 7).alias("chi2_pvalue"))


def _triplet_sql(up: str, down: str) -> str:
    return f"""{EV}, h AS (SELECT {bin_sql('mass_lep1jet1', *MASS, True)} AS bin, sum(weight_nominal) AS nominal,
      sum(weight_sys_pileup_UP) AS up, sum(weight_sys_pileup_DOWN) AS down FROM ev GROUP BY 1),
    d AS ({_dense('h', *MASS, f'coalesce(h.nominal, 0) AS nominal, coalesce(h.up, 0) AS up, {down} AS down')})"""


_BOTH = _triplet_sql("up", "coalesce(h.down, 0)")
_ONE = _triplet_sql("up", "2 * coalesce(h.nominal, 0) - coalesce(h.up, 0)")
_COMPARED = """SELECT bin, lo, hi, round(nominal, 6) AS nominal, round(up, 6) AS up, round(down, 6) AS down,
    round((up - nominal) / nullif(nominal, 0) * 100, 6) AS percent_up,
    round((down - nominal) / nullif(nominal, 0) * 100, 6) AS percent_down FROM d"""
_SIX = ["nominal", "up", "down", "percent_up", "percent_down"]


def _triplets(spark, sf):
    templates = hist.systematic_templates(events(spark, sf), "mass_lep1jet1", MASS[0], MASS[1:])
    return compare.template_triplets(templates, "weight_sys_pileup_UP", "weight_sys_pileup_DOWN")


@query("systematic_comparison", f"{_BOTH} {_COMPARED}")
def _(spark, sf):
    return rounded(compare.systematic_comparison(_triplets(spark, sf)), 6, *_SIX)


@query(
    "systematic_summary",
    f"""{_BOTH}, c AS (SELECT up, down, (up - nominal) / nullif(nominal, 0) * 100 AS pu, (down - nominal) / nullif(nominal, 0) * 100 AS pd FROM d)
    SELECT round(min(least(pu, pd)), 6) AS percent_min, round(max(greatest(pu, pd)), 6) AS percent_max,
      round(max(greatest(up, down)), 6) AS template_max FROM c""",
)
def _(spark, sf):
    summary = compare.systematic_summary(compare.systematic_comparison(_triplets(spark, sf)))
    return rounded(summary, 6, "percent_min", "percent_max", "template_max")


@query("one_sided_systematic", f"{_ONE} {_COMPARED}")
def _(spark, sf):
    return rounded(compare.one_sided_systematic(_triplets(spark, sf).drop("down")), 6, *_SIX)
