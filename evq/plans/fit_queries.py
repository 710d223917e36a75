"""Queries over fit results and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq import config
from evq.functions import text
from evq.functions.fit_keys import FitKey
from evq.operators import fits
from evq.plans.catalog import query, rounded
from evq.plans.views import (
    CONFIG_SQL,
    EXCLUDE_SQL,
    FIT_SQL,
    KEYED_EXCLUDE_SQL,
    KEYED_SQL,
    POI_SQL,
    SHOWER_NAMES,
    SHOWER_SQL,
    configs,
    exclusion_fits,
    fit_params,
    keyed_exclusion_fits,
    keyed_fits,
    poi_fits,
    shower_fits,
    table,
)
from evq.sources import fits as sources

# --- result files, as lines ------------------------------------------------------

# One line per row: parameters, gamma parameters, headers and rows of the correlation matrix.
_FIT_LINE = """CASE l_linenumber
  WHEN 7 THEN concat('gamma_stat_bin_', CAST(l_partkey AS STRING), '  1.0 0.1 -0.1')
  WHEN 6 THEN 'CORRELATION_MATRIX'
  WHEN 5 THEN '1.0 0.5 0.25 0.125'
  WHEN 4 THEN concat('NP_', CAST(l_partkey AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN ' nan -inf +Infinity' ELSE ' -NaN inf 0.5' END)
  ELSE concat('NP_', CAST(l_partkey AS STRING), '   -0.', CAST(CAST(l_quantity AS INT) AS STRING), '5  0.',
    CAST(l_linenumber AS STRING), '25 -0.', CAST(l_suppkey AS STRING), ' ') END"""
# Two workspaces with files of the same names.
_FIT_PATH = "concat('file:/results/ws', CAST(l_partkey % 2 AS STRING), '/Fits/fit', CAST(l_suppkey % 4 AS STRING), '.txt')"


def _lines(df, value: str, path: str):
    return df.selectExpr(f"{value} AS value", f"{path} AS path")


def _flat(df):
    """The key's parts as columns."""
    return df.select("fit.workspace", "fit.file", *[c for c in df.columns if c != "fit"])


@query(
    "read_fit_params",
    f"""WITH l AS (SELECT {_FIT_LINE} AS value, 'file:/results/ws' || (l_partkey % 2) AS workspace, 'fit' || (l_suppkey % 4) AS file FROM lineitem WHERE l_linenumber < 5),
    t AS (SELECT workspace, file, string_split_regex(trim(value), '\\s+') AS t FROM l)
    SELECT workspace, file, t[1] AS name, replace(t[2], '-NaN', 'NaN')::DOUBLE AS central, t[3]::DOUBLE AS sig_hi, t[4]::DOUBLE AS sig_lo FROM t""",
)
def _(spark, sf):
    return _flat(sources.parse_fit_params(_lines(table(spark, sf, "lineitem"), _FIT_LINE, _FIT_PATH)))


_RANK_LINE = """concat('NP_', CAST(p_partkey AS STRING), ' 0.', CAST(p_size AS STRING), ' 0.9', CAST(p_size AS STRING), ' -0.8',
  CAST(p_size AS STRING), ' 0.0', CAST(p_partkey AS STRING), ' -0.01', CAST(p_size AS STRING), ' 0.1', CAST(p_size AS STRING),
  '0000049 -0.2', CAST(p_size AS STRING))"""


@query(
    "read_np_ranking",
    f"""WITH t AS (SELECT 'file:/results/ws' || (p_partkey % 3) AS fit, concat('NP_', p_partkey // 3) AS name, string_split({_RANK_LINE}, ' ') AS t FROM part)
    SELECT fit, name, round_even(t[2]::DOUBLE, 6) AS central, round_even(t[3]::DOUBLE, 6) AS sig_hi, round_even(t[4]::DOUBLE, 6) AS sig_lo,
      round_even(t[5]::DOUBLE, 6) AS post_up, round_even(t[6]::DOUBLE, 6) AS post_down, round_even(t[7]::DOUBLE, 6) AS pre_up,
      round_even(t[8]::DOUBLE, 6) AS pre_down FROM t""",
)
def _(spark, sf):
    # Three workspaces that rank the same parameters.
    path = "concat('file:/results/ws', CAST(p_partkey % 3 AS STRING), '/Fits/NPRanking_NP_', CAST(p_partkey DIV 3 AS STRING), '.txt')"
    return sources.parse_np_ranking(_lines(table(spark, sf, "part"), _RANK_LINE, path))


_GROUP = "CASE WHEN p_partkey % 9 = 0 THEN 'Gammas' WHEN p_partkey % 10 = 0 THEN 'FullSyst' ELSE concat('Group_of_', p_brand, '_x') END"
_GROUP_LINE = f"""concat({_GROUP}, '   0.', CAST(p_size AS STRING), '   ( +0.', CAST(p_partkey AS STRING), ',  -0.1',
  CAST(p_size AS STRING), ' )')"""


def _group_lines(spark, sf):
    parts = table(spark, sf, "part").selectExpr("*", "regexp_replace(p_brand, ' ', '_') AS b")
    line = _GROUP_LINE.replace("p_brand", "b")
    return _lines(parts, line, "concat('file:/results/ws', CAST(p_partkey % 2 AS STRING), '/Fits/GroupedImpact.txt')")


_GROUPED_SQL = f"""WITH g AS (SELECT p_partkey, p_size, {_GROUP.replace('p_brand', "replace(p_brand, ' ', '_')")} AS n FROM part),
    i AS (SELECT 'file:/results/ws' || (p_partkey % 2) AS fit, replace(CASE WHEN n = 'Gammas' THEN 'Statistics' ELSE n END, '_', ' ') AS name, ('0.' || p_size)::DOUBLE AS avg,
      ('-0.1' || p_size)::DOUBLE AS sig_lo, ('+0.' || p_partkey)::DOUBLE AS sig_hi FROM g WHERE n <> 'FullSyst')"""


@query("read_grouped_impacts", f"{_GROUPED_SQL} SELECT * FROM i")
def _(spark, sf):
    return sources.parse_grouped_impacts(_group_lines(spark, sf))


@query(
    "grouped_impact_table",
    f"""{_GROUPED_SQL} SELECT fit, CAST(row_number() OVER (PARTITION BY fit ORDER BY lower(name), name, avg) - 1 AS INT) AS position, name,
      round(100 * round_even(avg, 3), 6) AS impact FROM i""",
)
def _(spark, sf):
    return rounded(fits.grouped_impact_table(sources.parse_grouped_impacts(_group_lines(spark, sf))), 6, "impact")


@query(
    "grouped_impact_table_descending",
    f"""{_GROUPED_SQL} SELECT fit, CAST(row_number() OVER (PARTITION BY fit ORDER BY avg DESC, name) - 1 AS INT) AS position, name,
      round(100 * round_even(avg, 3), 6) AS impact FROM i""",
)
def _(spark, sf):
    return rounded(fits.grouped_impact_table(sources.parse_grouped_impacts(_group_lines(spark, sf)), descending=True), 6, "impact")


_REGION = "concat('reg', CASE p_partkey % 3 WHEN 0 THEN '1j1b_' WHEN 1 THEN '2j1b_' ELSE '2j2b_' END, CAST(p_partkey AS STRING))"
# The same regions in two workspaces.
_CHI2_REGION = "concat('reg', CASE CAST(floor(p_partkey / 2) AS BIGINT) % 3 WHEN 0 THEN '1j1b_' WHEN 1 THEN '2j1b_' ELSE '2j2b_' END, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING))"


@query(
    "read_chi2",
    f"""SELECT 'file:/r/ws' || (p_partkey % 2) AS fit, {_CHI2_REGION} AS region, CASE WHEN p_size % 2 = 0 THEN 'pre' ELSE 'post' END AS stage, p_size + 0.25::DOUBLE AS chi2,
      p_size AS ndof, 1.0::DOUBLE / 4 AS probability FROM part""",
)
def _(spark, sf):
    lines = table(spark, sf, "part").selectExpr(
        "inline(array(struct(concat('chi2: ', CAST(p_size AS STRING), '.25') AS value), "
        "struct(concat('  ndof: ', CAST(p_size AS STRING)) AS value), struct('probability: 0.25 ' AS value), "
        "struct('comment: none' AS value)))",
        f"concat('file:/r/ws', CAST(p_partkey % 2 AS STRING), '/Histograms/', {_CHI2_REGION}, CASE WHEN p_size % 2 = 0 THEN '_pre' ELSE '_post' END, 'Fit_Chi2.txt') AS path",
    )
    return sources.parse_chi2(lines)


_BASE = "concat('reg2j2b_', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING), CASE WHEN p_size % 7 = 0 THEN '_asimov' ELSE '' END)"
_FILE = f"concat({_BASE}, CASE WHEN p_partkey % 3 = 0 THEN '_preFit.root' WHEN p_partkey % 3 = 1 THEN '_postFit.root' ELSE '_postFit_Chi2.txt' END)"


@query(
    "fit_inventory",
    f"""WITH f AS (SELECT 'file:/results/ws' || (p_size % 2) AS fit, {_FILE} AS name FROM part WHERE p_partkey % 3 < 2),
    r AS (SELECT fit, regexp_replace(name, '_(pre|post)Fit.root$', '') AS region, name LIKE '%preFit%' AS pre, name LIKE '%postFit%' AS post
      FROM f WHERE name NOT LIKE '%asimov%')
    SELECT fit, region, bool_or(post) AS has_postfit FROM r GROUP BY fit, region HAVING bool_or(pre)""",
)
def _(spark, sf):
    folder = "concat('file:/results/ws', CAST(p_size % 2 AS STRING), '/Histograms/x')"
    return sources.fit_inventory(table(spark, sf, "part").selectExpr(f"{_FILE} AS name", f"{folder} AS path"))


@query("postfit_available", f"SELECT bool_or(contains({_FILE}, 'postFit')) AS postfit FROM part")
def _(spark, sf):
    return sources.postfit_available(table(spark, sf, "part").selectExpr(f"{_FILE} AS name"))


# --- impacts --------------------------------------------------------------------

FP = f"WITH fp AS (SELECT *, greatest(abs(post_down), abs(post_up)) AS post_max FROM ({FIT_SQL}))"
_LEFTS = ", ".join(f"least({c}, 0) AS {c}_left" for c in fits.IMPACTS)


def _pretty_sql(name: str) -> str:
    for old, new in config.LABEL_REPLACEMENTS:
        name = f"replace({name}, '{old}', '{new}')"
    return name


@query("np_impacts", f"{FP} SELECT * FROM fp ORDER BY post_max, name")
def _(spark, sf):
    return fits.np_impacts(fit_params(spark, sf))


@query(
    "top_impacts",
    f"""{FP} SELECT *, CAST(row_number() OVER (PARTITION BY fit ORDER BY post_max DESC, name) AS INT) AS rank FROM fp
    QUALIFY row_number() OVER (PARTITION BY fit ORDER BY post_max DESC, name) <= 20""",
)
def _(spark, sf):
    return fits.top_impacts(fit_params(spark, sf), 20)


@query(
    "impact_bars",
    f"""{FP}, top AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY fit ORDER BY post_max DESC, name) <= 20)
    SELECT *, CAST(row_number() OVER (PARTITION BY fit ORDER BY post_max, name DESC) - 1 AS INT) AS ys, {_LEFTS},
      {_pretty_sql('name')} AS label FROM top""",
)
def _(spark, sf):
    return fits.impact_bars(fit_params(spark, sf), 20)


@query(
    "impact_bars_all",
    f"""{FP} SELECT *, CAST(row_number() OVER (PARTITION BY fit ORDER BY post_max, name DESC) - 1 AS INT) AS ys, {_LEFTS},
      {_pretty_sql('name')} AS label FROM fp""",
)
def _(spark, sf):
    return fits.impact_bars(fit_params(spark, sf), None)


# --- pairs of fits --------------------------------------------------------------

_DELTA = """SELECT a.name, round(a.central - b.central, 9) AS delta, round(sqrt(a.sig_hi * a.sig_hi + b.sig_hi * b.sig_hi), 9) AS delta_up,
    round(sqrt(a.sig_lo * a.sig_lo + b.sig_lo * b.sig_lo), 9) AS delta_down FROM fp a JOIN fp b ON a.name = b.name AND a.fit = 'fit0' AND b.fit = 'fit1'"""
_DELTAS = ["delta", "delta_up", "delta_down"]


@query("delta_param", f"{FP} {_DELTA}")
def _(spark, sf):
    return rounded(fits.delta_param(fit_params(spark, sf), "fit0", "fit1"), 9, *_DELTAS)


@query("delta_poi", f"WITH fp AS ({POI_SQL}) {_DELTA}")
def _(spark, sf):
    return rounded(fits.delta_poi(poi_fits(spark, sf), "fit0", "fit1"), 9, *_DELTAS)


def _compared_sql(quantities: dict[str, tuple[str, str]], source: str = "fp") -> str:
    rows = []
    for shown, (c, rule) in quantities.items():
        sign = "<" if rule == "tighter" else ">"
        change = (
            f"abs(abs(a.{c}) - abs(b.{c}))"
            if rule == "tighter"
            else f"(greatest(abs(a.{c}), abs(b.{c})) - least(abs(a.{c}), abs(b.{c}))) / nullif(least(abs(a.{c}), abs(b.{c})), 0) * 100"
        )
        rows.append(
            f"""SELECT a.name, '{shown}' AS quantity, a.{c} AS value_1, b.{c} AS value_2, '{rule}' AS rule,
            CASE WHEN abs(a.{c}) {sign} abs(b.{c}) THEN 'fit0' ELSE 'fit1' END AS which, {change} AS change
            FROM {source} a JOIN {source} b ON a.name = b.name AND a.fit = 'fit0' AND b.fit = 'fit1'"""
        )
    return " UNION ALL ".join(rows)


_UNCERTAINTY = {"up": ("sig_hi", "larger"), "down": ("sig_lo", "larger")}
_NUISPAR = {
    "sig_lo": ("sig_lo", "tighter"),
    "sig_hi": ("sig_hi", "tighter"),
    "pre_up": ("pre_up", "larger"),
    "pre_down": ("pre_down", "larger"),
    "post_up": ("post_up", "larger"),
    "post_down": ("post_down", "larger"),
}


@query("compare_uncertainty", f"{FP} {_compared_sql(_UNCERTAINTY)}")
def _(spark, sf):
    return fits.compare_uncertainty(fit_params(spark, sf), "fit0", "fit1")


@query("compare_nuispar", f"{FP} {_compared_sql(_NUISPAR)}")
def _(spark, sf):
    return fits.compare_nuispar(fit_params(spark, sf), "fit0", "fit1")


@query(
    "comparison_summary",
    f"WITH poi AS ({POI_SQL}), sh AS ({SHOWER_SQL}) {_compared_sql(_UNCERTAINTY, 'poi')} UNION ALL {_compared_sql(_NUISPAR, 'sh')}",
)
def _(spark, sf):
    both = poi_fits(spark, sf).unionByName(shower_fits(spark, sf))
    return fits.comparison_summary(both, "fit0", "fit1", nuispars=SHOWER_NAMES)


# --- nominal against many -------------------------------------------------------


def _against_sql(source: str, nominal: str, keep: str, join: str, where: str) -> str:
    return f"""WITH f AS ({source}), n AS (SELECT * FROM f WHERE fit = '{nominal}')
    SELECT {keep}, round(n.central - f.central, 9) AS delta, round(sqrt(n.sig_hi * n.sig_hi + f.sig_hi * f.sig_hi), 9) AS delta_up,
      round(sqrt(n.sig_lo * n.sig_lo + f.sig_lo * f.sig_lo), 9) AS delta_down FROM f {join}, n WHERE {where}"""


_LEFT_OUT = "replace(f.fit, 'tW_exclude-', '')"


@query(
    "excluded_systematics_delta",
    _against_sql(
        EXCLUDE_SQL,
        "tW",
        f"{_LEFT_OUT} AS excluded, {_pretty_sql(_LEFT_OUT)} AS label",
        "",
        "f.fit LIKE 'tW_exclude-%' AND f.fit NOT LIKE '%saturatedModel%'",
    ),
)
def _(spark, sf):
    return rounded(fits.excluded_systematics_delta(exclusion_fits(spark, sf)), 9, *_DELTAS)


# --- the same file names in two workspaces -------------------------------------------

_WS = "file:/results/ws"
_ONE, _TWO = FitKey(f"{_WS}0", "fit0"), FitKey(f"{_WS}1", "fit0")
_KEYED_PAIR = f"""FROM ({KEYED_SQL}) a JOIN ({KEYED_SQL}) b ON a.name = b.name AND a.file = 'fit0' AND b.file = 'fit0'
    AND a.workspace = '{_WS}0' AND b.workspace = '{_WS}1'"""


@query(
    "delta_param_workspaces",
    f"""SELECT a.name, round(a.central - b.central, 9) AS delta, round(sqrt(a.sig_hi * a.sig_hi + b.sig_hi * b.sig_hi), 9) AS delta_up,
    round(sqrt(a.sig_lo * a.sig_lo + b.sig_lo * b.sig_lo), 9) AS delta_down {_KEYED_PAIR}""",
)
def _(spark, sf):
    return rounded(fits.delta_param(keyed_fits(spark, sf), _ONE, _TWO), 9, *_DELTAS)


@query(
    "compare_uncertainty_workspaces",
    " UNION ALL ".join(
        f"""SELECT a.name, '{shown}' AS quantity, a.{c} AS value_1, b.{c} AS value_2, 'larger' AS rule,
        CASE WHEN abs(a.{c}) > abs(b.{c}) THEN '{_ONE}' ELSE '{_TWO}' END AS which,
        round((greatest(abs(a.{c}), abs(b.{c})) - least(abs(a.{c}), abs(b.{c}))) / least(abs(a.{c}), abs(b.{c})) * 100.0, 6) AS change {_KEYED_PAIR}"""
        for shown, c in (("up", "sig_hi"), ("down", "sig_lo"))
    ),
)
def _(spark, sf):
    return rounded(fits.compare_uncertainty(keyed_fits(spark, sf), _ONE, _TWO), 6, "change")


@query(
    "excluded_systematics_delta_workspaces",
    f"""WITH f AS ({KEYED_EXCLUDE_SQL}), n AS (SELECT * FROM f WHERE file = 'tW')
    SELECT f.workspace, replace(f.file, 'tW_exclude-', '') AS excluded, {_pretty_sql("replace(f.file, 'tW_exclude-', '')")} AS label, round(n.central - f.central, 9) AS delta,
      round(sqrt(n.sig_hi * n.sig_hi + f.sig_hi * f.sig_hi), 9) AS delta_up, round(sqrt(n.sig_lo * n.sig_lo + f.sig_lo * f.sig_lo), 9) AS delta_down
    FROM f JOIN n USING (workspace) WHERE f.file LIKE 'tW_exclude-%' AND f.file NOT LIKE '%saturatedModel%'""",
)
def _(spark, sf):
    return rounded(fits.excluded_systematics_delta(keyed_exclusion_fits(spark, sf)), 9, *_DELTAS)


@query(
    "top_impacts_workspaces",
    f"""SELECT workspace, file, name, post_max, rank FROM (SELECT *, greatest(abs(post_down), abs(post_up)) AS post_max,
      CAST(row_number() OVER (PARTITION BY workspace, file ORDER BY greatest(abs(post_down), abs(post_up)) DESC, name) AS INT) AS rank FROM ({KEYED_SQL})) WHERE rank <= 20""",
)
def _(spark, sf):
    return _flat(fits.top_impacts(keyed_fits(spark, sf)).select("fit", "name", "post_max", "rank"))


_KEYED_CONFIGS = [(c, f"{c} in {w}", FitKey(f"{_WS}{w}", f"fit{i}")) for w in (0, 1) for i, c in enumerate(("main", "1j1b", "1j1b2j1b"))]


@query(
    "region_delta_workspaces",
    f"""WITH f AS (SELECT * FROM ({KEYED_SQL}) WHERE name = 'NP_1'), c(config, label, workspace, file) AS (VALUES {", ".join(f"('{c}', '{t}', '{k.workspace}', '{k.file}')" for c, t, k in _KEYED_CONFIGS)}),
    n AS (SELECT * FROM f WHERE workspace = '{_ONE.workspace}' AND file = 'fit0')
    SELECT c.config, c.label, round(n.central - f.central, 9) AS delta, round(sqrt(n.sig_hi * n.sig_hi + f.sig_hi * f.sig_hi), 9) AS delta_up,
      round(sqrt(n.sig_lo * n.sig_lo + f.sig_lo * f.sig_lo), 9) AS delta_down FROM f JOIN c USING (workspace, file), n WHERE c.config <> 'main'""",
)
def _(spark, sf):
    keys = spark.createDataFrame(_KEYED_CONFIGS, "config string, label string, fit struct<workspace:string,file:string>")
    return rounded(fits.region_delta(keyed_fits(spark, sf), keys, _ONE, poi="NP_1"), 9, *_DELTAS)


@query(
    "region_delta",
    _against_sql(
        POI_SQL, "fit0", "c.config, c.label", f"JOIN ({CONFIG_SQL}) c ON c.fit = f.fit", "c.config IN ('1j1b', '1j1b2j1b', '1j1b2j2b')"
    ),
)
def _(spark, sf):
    return rounded(fits.region_delta(poi_fits(spark, sf), configs(spark), "fit0"), 9, *_DELTAS)


@query(
    "campaign_delta",
    _against_sql(POI_SQL, "fit0", "c.config, c.label", f"JOIN ({CONFIG_SQL}) c ON c.fit = f.fit", "c.config IN ('1516', '17', '18')"),
)
def _(spark, sf):
    return rounded(fits.campaign_delta(poi_fits(spark, sf), configs(spark), "fit0"), 9, *_DELTAS)


@query(
    "param_pulls_by_config",
    f"""SELECT c.config, c.label, f.name, f.central, f.sig_hi, f.sig_lo FROM ({POI_SQL}) f JOIN ({CONFIG_SQL}) c USING (fit)""",
)
def _(spark, sf):
    return fits.param_pulls_by_config(poi_fits(spark, sf), configs(spark), config.DEFAULT_POI)


@query(
    "impact_across_configs",
    f"""WITH f AS (SELECT *, greatest(abs(post_down), abs(post_up)) AS post_max FROM ({SHOWER_SQL}))
    SELECT c.config, concat_ws(' ', c.label, {_pretty_sql('f.name')}) AS label, f.name, central, sig_hi, sig_lo, pre_down, pre_up, post_down, post_up,
      post_max, {_LEFTS}, CAST(row_number() OVER (PARTITION BY f.name ORDER BY post_max, config) - 1 AS INT) AS ys
    FROM f JOIN ({CONFIG_SQL}) c USING (fit)""",
)
def _(spark, sf):
    return fits.impact_across_configs(shower_fits(spark, sf), configs(spark), SHOWER_NAMES, sort=True)


# Parameters of one size have no systematic, so that the inner join has something to drop.
_SYSTEMATIC_SQL = """SELECT concat('NP_', p_partkey) AS name, p_type AS category, concat('title of ', p_name) AS title FROM part
  WHERE p_size <> 13"""


def _systematics(spark, sf):
    return table(spark, sf, "part").filter("p_size <> 13").select(
        F.concat(F.lit("NP_"), "p_partkey").alias("name"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("title of "), "p_name").alias("title"),
    )


@query(
    "pulls_by_category",
    f"""{FP} SELECT s.category, s.name, s.title, fp.central AS mean, fp.sig_hi AS plus, fp.sig_lo AS minus, fp.fit
    FROM fp JOIN ({_SYSTEMATIC_SQL}) s USING (name)""",
)
def _(spark, sf):
    return fits.pulls_by_category(fit_params(spark, sf), _systematics(spark, sf), keep=["fit"])


@query(
    "pulls_by_category_workspaces",
    f"""SELECT s.category, s.name, s.title, f.central AS mean, f.sig_hi AS plus, f.sig_lo AS minus, f.workspace, f.file
    FROM ({KEYED_SQL}) f JOIN ({_SYSTEMATIC_SQL}) s USING (name)""",
)
def _(spark, sf):
    pulls = fits.pulls_by_category(keyed_fits(spark, sf), _systematics(spark, sf), keep=["fit"])
    return _flat(pulls)


# --- labels ---------------------------------------------------------------------

_LABEL = """concat(CASE p_partkey % 6 WHEN 0 THEN 'ttbar_AR_muF_' WHEN 1 THEN 'tW_DRDS_' WHEN 2 THEN 'JET_EffectiveNP_' WHEN 3 THEN 'ttbar_hdamp_'
  WHEN 4 THEN 'MET_SoftTrk_RhoT_' ELSE 'ptreweight_EffNP_muR_' END, p_brand)"""


@query("prettify_label", f"SELECT p_partkey, {_pretty_sql(_LABEL)} AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.prettify_label(F.expr(_LABEL)).alias("label"))


@query(
    "meta_text",
    f"""SELECT p_partkey, '$tW$ Dilepton, ' || CASE p_partkey % 3 WHEN 0 THEN '1j1b' WHEN 1 THEN '2j1b' ELSE '2j2b' END
      || CASE WHEN p_size % 2 = 0 THEN ', Pre-fit' ELSE ', Post-fit' END AS meta FROM part""",
)
def _(spark, sf):
    stage = F.expr("CASE WHEN p_size % 2 = 0 THEN 'pre' ELSE 'post' END")
    return table(spark, sf, "part").select("p_partkey", text.meta_text(F.expr(_REGION), stage).alias("meta"))


_TITLES = [("1-URGENT", "$m_{u}$", "GeV"), ("2-HIGH", "$p_{T}$", "GeV"), ("3-MEDIUM", "BDT", ""), ("5-LOW", "$H_{T}$", None)]
_TITLE_SQL = "SELECT * FROM (VALUES {}) AS t(name, mpl, unit)".format(
    ", ".join("('{}', '{}', {})".format(n, m, "NULL" if u is None else f"'{u}'") for n, m, u in _TITLES)
)


@query(
    "axis_label",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS k, o_custkey % 100 / 4.0 AS w FROM orders)
    SELECT o_orderkey, mpl || CASE WHEN unit <> '' THEN ' [' || unit || ']' ELSE '' END AS x_label,
      CASE WHEN mpl IS NOT NULL THEN 'Events/' || CASE WHEN w = floor(w) THEN CAST(CAST(w AS BIGINT) AS VARCHAR) ELSE printf('%.2f', w::DOUBLE) END
        || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END END AS y_label
    FROM o LEFT JOIN ({_TITLE_SQL}) t ON t.name = o.k""",
)
def _(spark, sf):
    titles = spark.createDataFrame(_TITLES, "name string, mpl string, unit string")
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "concat(CASE WHEN o_custkey % 2 = 0 THEN 'reg2j2b_VRP_' ELSE '' END, o_orderpriority) AS region",
        "CAST(o_custkey % 100 AS DOUBLE) / 4.0 AS bin_width",
    )
    return text.axis_label(rows, titles).select("o_orderkey", "x_label", "y_label")


@query(
    "chisq_text",
    r"""SELECT p_partkey, printf('$\chi^2/\mathrm{ndf} = %.2f / %d$, ', p_size / 4.0::DOUBLE, p_size) ||
      printf('$\chi^2_{\mathrm{prob}} = %.2f$', p_size % 4 / 4.0::DOUBLE) AS label FROM part""",
)
def _(spark, sf):
    label = text.chisq_text(F.expr("p_size / 4.0D"), F.col("p_size"), F.expr("p_size % 4 / 4.0D"))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"))


_LOG_NAME = "concat(p_brand, CASE p_partkey % 3 WHEN 0 THEN '_genericMT2' WHEN 1 THEN '_genericMT2_low' ELSE '_met' END)"


@query("log_scale_flag", "SELECT p_partkey, p_partkey % 3 = 0 AS log_scale FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.log_scale_flag(F.expr(_LOG_NAME)).alias("log_scale"))
