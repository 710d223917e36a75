"""Test views over the provided tables, as expressions read alike by Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.regions import features_for

EVENTS = {
    "event_id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))",
    "process": "CASE l_suppkey % 6 WHEN 0 THEN 'Data' WHEN 1 THEN 'tW_DR' WHEN 2 THEN 'ttbar' "
    "WHEN 3 THEN 'Zjets' WHEN 4 THEN 'Diboson' ELSE 'MCNP' END",
    "sample_group": "CASE l_partkey % 5 WHEN 0 THEN 'tW_DR' WHEN 1 THEN 'tW_DS' WHEN 2 THEN 'ttbar' "
    "WHEN 3 THEN 'ttbar_inc_AFII' ELSE 'ttbar_PS' END",
    "campaign": "CASE l_partkey % 3 WHEN 0 THEN 'MC16a' WHEN 1 THEN 'MC16d' ELSE 'MC16e' END",
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "reg1j1b": "l_linenumber IN (1,2)",
    "reg2j1b": "l_linenumber IN (3,4)",
    "reg2j2b": "l_linenumber IN (5,6)",
    "OS": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "pT_lep1": "l_extendedprice / 1000.0",
    "mass_lep1jet1": "l_quantity * 5.0",
    "pT_jet2": "CAST(l_partkey % 100 AS DOUBLE)",
    "pTsys_lep1lep2": "l_extendedprice / 500.0 + l_quantity * 0.01",
    "E_jet1": "l_extendedprice / 1000.0 + 1.0",
    "const_feature": "CAST(1.0 AS DOUBLE)",
    "weight_nominal": "l_discount - 0.02",
    "weight_sys_pileup_UP": "(l_discount - 0.02) * (1.0 + l_tax)",
    "weight_sys_pileup_DOWN": "(l_discount - 0.02) * (1.0 - l_tax)",
    "weight_sys_noreweight": "l_discount - 0.02",
    "weight_tptrw_tool": "1.0 - l_tax / 2.0",
    "weight_trrw_tool": "1.0 + l_tax / 4.0",
    "weight_campaign": "CAST(CASE l_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 1.1 END AS DOUBLE)",
    "score": "0.5 * l_quantity / 50.0 + CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 0.0 END",
}

# The other features of the three regions, so that feature lists and training tables are complete.
WIDE = {
    **EVENTS,
    **{
        name: f"l_quantity * {i + 1}.0 + l_extendedprice / {100 * (i + 1)}.0 + l_tax * {10 * i}.0"
        for i, name in enumerate(f for f in features_for("ALL") if f not in EVENTS)
    },
}

FIT_KEYS = {
    "fit": "concat('fit', CAST(l_suppkey % 4 AS STRING))",
    "name": "concat('NP_', CAST(l_partkey AS STRING))",
}
FIT_VALUES = {
    "central": "round(avg(l_quantity) / 25.0 - 1.0, 9)",
    "sig_hi": "round(max(l_tax) * 10.0 + 0.1, 9)",
    "sig_lo": "round(-(max(l_discount) * 10.0 + 0.1), 9)",
    "pre_up": "round(sum(l_tax) / 10.0, 9)",
    "pre_down": "round(-sum(l_discount) / 10.0, 9)",
    "post_up": "round(avg(l_tax), 9)",
    "post_down": "round(-avg(l_discount), 9)",
}

# File names of every kind, one per part.
NAME = """CASE
  WHEN p_partkey % 17 = 0 THEN 'tW_DR_410_bad'
  WHEN p_partkey % 13 = 0 THEN concat('Data1', CAST(5 + p_size % 4 AS STRING), '_data1',
    CAST(5 + p_size % 4 AS STRING), '_Data_Data_nominal.root')
  ELSE concat(
    CASE p_partkey % 12 WHEN 0 THEN 'tW_DR_410648' WHEN 1 THEN 'tW_DR_410649' WHEN 2 THEN 'tW_DR_411038'
      WHEN 3 THEN 'tW_DR_410646' WHEN 4 THEN 'tW_DS_410656' WHEN 5 THEN 'tW_DS_410655'
      WHEN 6 THEN 'ttbar_410472' WHEN 7 THEN 'ttbar_410558' WHEN 8 THEN 'ttbar_410470'
      WHEN 9 THEN 'Diboson_364255' WHEN 10 THEN 'MCNP_Zjets_364137' ELSE 'MCNP_364137' END,
    CASE WHEN p_size % 2 = 0 THEN '_FS_' ELSE '_AFII_' END,
    CASE p_size % 3 WHEN 0 THEN 'MC16a' WHEN 1 THEN 'MC16d' ELSE 'MC16e' END,
    CASE WHEN p_size % 5 = 0 THEN '_EG_SCALE_ALL__1up' ELSE '_nominal' END,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE '.root' END) END"""


def _select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())


EVENT_SQL = f"SELECT {_select(EVENTS)} FROM lineitem"
WIDE_SQL = f"SELECT {_select(WIDE)} FROM lineitem"
FIT_SQL = f"SELECT {_select({**FIT_KEYS, **FIT_VALUES})} FROM lineitem GROUP BY l_suppkey % 4, l_partkey"
NAME_SQL = f"SELECT {NAME} AS name, p_partkey AS part FROM part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in EVENTS.items()])


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in WIDE.items()])


def _fit_values(rows: DataFrame, **keys: str) -> DataFrame:
    grouped = rows.groupBy(*[F.expr(sql).alias(name) for name, sql in keys.items()])
    return grouped.agg(*[F.expr(sql).alias(name) for name, sql in FIT_VALUES.items()])


def fit_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fit and nuisance parameter."""
    return _fit_values(table(spark, sf_dir, "lineitem"), **FIT_KEYS)


# The parameter of interest of each fit, from all rows of the fit.
POI_KEYS = {"fit": FIT_KEYS["fit"], "name": "'SigXsecOverSM'"}
POI_SQL = f"SELECT {_select({**POI_KEYS, **FIT_VALUES})} FROM lineitem GROUP BY l_suppkey % 4"


def poi_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_values(table(spark, sf_dir, "lineitem"), **POI_KEYS)


# A fit without each nuisance parameter, next to the complete one.
EXCLUDE_FIT = (
    "concat('tW_exclude-', CASE WHEN l_partkey % 50 = 0 THEN 'saturatedModel_' ELSE 'tW_NP_' END, "
    "CAST(l_partkey AS STRING))"
)
EXCLUDE_SQL = (
    f"SELECT {EXCLUDE_FIT} AS fit, 'SigXsecOverSM' AS name, {_select(FIT_VALUES)} FROM lineitem GROUP BY l_partkey "
    f"UNION ALL SELECT 'tW' AS fit, 'SigXsecOverSM' AS name, {_select(FIT_VALUES)} FROM lineitem"
)


def exclusion_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    poi = F.lit("SigXsecOverSM")
    values = list(FIT_VALUES)
    return (
        _fit_values(rows, fit=EXCLUDE_FIT)
        .select("fit", poi.alias("name"), *values)
        .unionByName(_fit_values(rows, fit="'tW'").select("fit", poi.alias("name"), *values))
    )


# The same file names in two workspaces: the fit is a key of both.
KEYED = {"workspace": "concat('file:/results/ws', CAST(l_suppkey % 2 AS STRING))", "file": "concat('fit', CAST(l_suppkey % 3 AS STRING))"}
KEYED_SQL = f"SELECT {_select({**KEYED, 'name': FIT_KEYS['name'], **FIT_VALUES})} FROM lineitem GROUP BY l_suppkey % 2, l_suppkey % 3, l_partkey"
KEYED_EXCLUDE_SQL = (
    f"SELECT {KEYED['workspace']} AS workspace, {EXCLUDE_FIT} AS file, 'SigXsecOverSM' AS name, {_select(FIT_VALUES)} FROM lineitem GROUP BY l_suppkey % 2, l_partkey "
    f"UNION ALL SELECT {KEYED['workspace']} AS workspace, 'tW' AS file, 'SigXsecOverSM' AS name, {_select(FIT_VALUES)} FROM lineitem GROUP BY l_suppkey % 2"
)


def _keyed(rows: DataFrame, **keys: str) -> DataFrame:
    values = _fit_values(rows, **keys)
    return values.select(F.struct("workspace", "file").alias("fit"), *[c for c in values.columns if c not in ("workspace", "file")])


def keyed_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(table(spark, sf_dir, "lineitem"), **KEYED, name=FIT_KEYS["name"])


def keyed_exclusion_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, poi = table(spark, sf_dir, "lineitem"), "'SigXsecOverSM'"
    parts = [_keyed(rows, workspace=KEYED["workspace"], file=file, name=poi) for file in (EXCLUDE_FIT, "'tW'")]
    return parts[0].unionByName(parts[1])


# Impacts of a handful of parameters in every fit.
SHOWER_KEYS = {"fit": FIT_KEYS["fit"], "name": "concat('ttbar_PS_', CAST(l_linenumber AS STRING))"}
SHOWER_SQL = f"SELECT {_select({**SHOWER_KEYS, **FIT_VALUES})} FROM lineitem GROUP BY l_suppkey % 4, l_linenumber"
SHOWER_NAMES = [f"ttbar_PS_{i}" for i in range(1, 8)]


def shower_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_values(table(spark, sf_dir, "lineitem"), **SHOWER_KEYS)


CONFIGS = [
    ("main", "Complete", "fit0"),
    ("1j1b", "1j1b only", "fit1"),
    ("1j1b2j1b", "1j1b + 2j1b", "fit2"),
    ("1j1b2j2b", "1j1b + 2j2b", "fit3"),
    ("1516", "2015/2016", "fit1"),
    ("17", "2017", "fit2"),
    ("18", "2018", "fit3"),
]
CONFIG_SQL = "SELECT * FROM (VALUES {}) AS t(config, label, fit)".format(
    ", ".join(f"('{c}', '{label}', '{f}')" for c, label, f in CONFIGS)
)


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGS, "config string, label string, fit string")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(f"{NAME} AS name", "p_partkey AS part")


# A scan result per supplier.
SCAN = {
    "name": "concat('scan', CAST(l_suppkey AS STRING))",
    "auc": "round(0.5 + avg(l_quantity) / 120.0, 6)",
    "ks_test_sig": "round(max(l_tax), 6)",
    "ks_pvalue_sig": "round(avg(l_tax) * 10.0 + l_suppkey % 7 / 20.0, 6)",
    "ks_test_bkg": "round(max(l_discount), 6)",
    "ks_pvalue_bkg": "round(avg(l_discount) * 10.0 + l_suppkey % 5 / 8.0, 6)",
    "bad_ks": "l_suppkey % 11 = 0",
}
SCAN_SQL = f"SELECT {_select(SCAN)} FROM lineitem GROUP BY l_suppkey"


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
            *[F.expr(sql).alias(n) for n, sql in SCAN.items() if n not in ("name", "bad_ks")]
        ).selectExpr(f"{SCAN['name']} AS name", *[n for n in SCAN if n not in ("name", "bad_ks")], f"{SCAN['bad_ks']} AS bad_ks")
    )
