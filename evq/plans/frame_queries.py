"""Queries over the readers, selections, weights, samples and training tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evq import config
from evq.functions.regions import by_name, categorize_columns, features_for, normalize_region
from evq.functions.selections import selection_for
from evq.operators import frames, prep, sampling
from evq.plans.catalog import query, rounded, unit_sql
from evq.plans.views import (
    EVENT_SQL,
    EVENTS,
    NAME_SQL,
    WIDE,
    WIDE_SQL,
    events,
    file_names,
    table,
    wide_events,
)
from evq.plans.session import shared_folder
from evq.sources import events as sources

EV = f"WITH ev AS ({EVENT_SQL})"
WD = f"WITH ev AS ({WIDE_SQL})"
KEY = "event_id"


def cols(*names) -> str:
    return ", ".join(names)


# --- sources --------------------------------------------------------------------


@query(
    "read_events",
    "SELECT l_discount, l_extendedprice, l_quantity, l_shipdate FROM lineitem",
)
def _(spark, sf):
    return sources.read_events(
        spark, [f"{sf}/lineitem.parquet"], ["l_quantity", "l_extendedprice", "l_shipdate"], weight_name="l_discount"
    )


@query(
    "select_events",
    f"""{EV} SELECT event_id, mass_lep1jet1, pT_jet2, pT_lep1, pTsys_lep1lep2,
      weight_nominal * weight_campaign * weight_tptrw_tool * weight_trrw_tool AS weight_nominal
    FROM ev WHERE {unit_sql()} < {int(round(0.7 * 2**32))} AND OS = 1 AND reg2j2b AND mass_lep1jet1 < 155""",
)
def _(spark, sf):
    wanted = [KEY, "mass_lep1jet1", "pT_jet2", "pT_lep1", "pTsys_lep1lep2", "E_jet1", "weight_nominal"]
    return frames.select_events(
        events(spark, sf),
        "OS == true && reg2j2b == true && mass_lep1jet1 < 155",
        columns=wanted,
        keep_category="kinematics",
        exclude_avoids=True,
        use_campaign_weight=True,
        use_tptrw=True,
        use_trrw=True,
        sample_fraction=0.7,
        key=KEY,
    )


_INFO = r"^(\w+)_([0-9]{6})_(FS|AFII)_(MC16[ade])_(\w+)(\.\w+|$)"


@query(
    "sample_info",
    f"""WITH f AS ({NAME_SQL}), p AS (
      SELECT part, name, contains(name, 'Data_Data') AS data, regexp_matches(name, '{_INFO}') AS ok FROM f)
    SELECT part, name,
      CASE WHEN data THEN 'Data' WHEN ok AND name LIKE 'MCNP%' THEN 'MCNP'
        WHEN ok THEN regexp_extract(name, '{_INFO}', 1) END AS phy_process,
      CASE WHEN data THEN 0 WHEN ok THEN CAST(regexp_extract(name, '{_INFO}', 2) AS INT) END AS dsid,
      CASE WHEN data THEN 'Data' WHEN ok THEN regexp_extract(name, '{_INFO}', 3) END AS sim_type,
      CASE WHEN data THEN 'Data' WHEN ok THEN regexp_extract(name, '{_INFO}', 4) END AS campaign,
      CASE WHEN data THEN 'nominal' WHEN ok THEN regexp_extract(name, '{_INFO}', 5) END AS tree,
      data OR ok AS is_valid FROM p""",
)
def _(spark, sf):
    return sources.sample_info(file_names(spark, sf))


def _group_sql(letters: str, years: str) -> str:
    known = ", ".join(
        f"('{g}', '{process}', '{d}', '{sim}')"
        for g, (process, dsid, sim) in config.SAMPLE_GROUPS.items()
        for d in dsid.split("|")
    )
    shape = rf"^(tW_DR|tW_DS|ttbar|Diboson|Zjets|MCNP)_([0-9]{{6}})_(FS|AFII)_MC16[{letters}]_nominal.root$"
    return f"""WITH f AS ({NAME_SQL}), k AS (SELECT * FROM (VALUES {known}) AS k(g, process, dsid, sim)),
    p AS (SELECT part, name, regexp_extract(name, '{shape}', 1) AS process, regexp_extract(name, '{shape}', 2) AS dsid,
      regexp_extract(name, '{shape}', 3) AS sim FROM f)
    SELECT part, name, CASE WHEN regexp_matches(name, '^Data1[{years}]_data1[{years}]_Data_Data_nominal.root$')
      THEN 'Data' ELSE k.g END AS sample_group
    FROM p LEFT JOIN k ON p.process = k.process AND p.sim = k.sim
      AND (p.dsid = k.dsid OR (k.dsid = '[0-9]{{6}}' AND p.dsid <> ''))"""


@query("sample_group", _group_sql("ade", "5678"))
def _(spark, sf):
    return sources.sample_group(file_names(spark, sf))


@query("sample_group_campaign", _group_sql("a", "56"))
def _(spark, sf):
    return sources.sample_group(file_names(spark, sf), campaign="MC16a")


def _region_sample_columns(region: str) -> list[str]:
    names = categorize_columns(WIDE)["kinematics"]
    gone = set(config.AVOID) | set(config.AVOID_BY_REGION[region]) | set(config.ALWAYS_DROP[region])
    names = [c for c in names if c not in gone and not (region == "1j1b" and "jet2" in c)]
    return by_name({*names, "weight_nominal"})


@query(
    "region_sample",
    f"{WD} SELECT {cols(*_region_sample_columns('1j1b'))} FROM ev "
    "WHERE reg1j1b AND OS = 1 AND sample_group IN ('tW_DR', 'tW_DS', 'ttbar')",
)
def _(spark, sf):
    df = wide_events(spark, sf).filter(F.col("sample_group").isin("tW_DR", "tW_DS", "ttbar"))
    return sources.region_sample(df, "1j1b", key="sample_group")


@query(
    "write_region_samples",
    f"""{WD} SELECT CASE WHEN reg1j1b THEN '1j1b' WHEN reg2j1b THEN '2j1b' ELSE '2j2b' END AS region, sample_group,
      count(*) AS events, round(sum(weight_nominal), 6) AS weight, round(sum(pTsys_lep1lep2), 2) AS total FROM ev
    WHERE (reg1j1b OR reg2j1b OR reg2j2b) AND OS = 1 AND sample_group IN ('tW_DR', 'tW_DS', 'ttbar') GROUP BY ALL""",
)
def _(spark, sf):
    path = shared_folder(spark, "samples")
    parts = [
        sources.read_region_sample(spark, path, region).select(F.lit(region).alias("region"), "sample_group", "weight_nominal", "pTsys_lep1lep2")
        for region in sources.write_region_samples(wide_events(spark, sf), path)
    ]
    sums = reduce(lambda a, b: a.unionByName(b), parts).groupBy("region", "sample_group").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("weight_nominal").alias("weight"),
        F.sum("pTsys_lep1lep2").alias("total"),
    )
    return rounded(rounded(sums, 6, "weight"), 2, "total")


# --- rows and columns -----------------------------------------------------------

_SPELLINGS = {
    "where_selection": "OS == 1 && reg2j2b == 1 && mass_lep1jet1 < 155",
    "where_selection_numexpr": "(OS == True) & (reg2j2b == True) & (mass_lep1jet1 < 155)",
}
for _name, _text in _SPELLINGS.items():
    query(_name, f"{EV} SELECT event_id, mass_lep1jet1 FROM ev WHERE OS = 1 AND reg2j2b AND mass_lep1jet1 < 155")(
        lambda spark, sf, text=_text: frames.where_selection(events(spark, sf), text).select(KEY, "mass_lep1jet1")
    )


@query(
    "where_selection_negation",
    f"{EV} SELECT event_id FROM ev WHERE (NOT (OS = 1 AND reg1j1b)) AND (pT_lep1 > 20 OR NOT reg2j2b)",
)
def _(spark, sf):
    text = "!(OS == 1 && reg1j1b) && (pT_lep1 > 20 || !reg2j2b)"
    return frames.where_selection(events(spark, sf), text).select(KEY)


@query("select_region", f"{EV} SELECT event_id, pT_lep1 FROM ev WHERE reg2j1b AND OS = 1 AND pT_lep1 < 50")
def _(spark, sf):
    return frames.select_region(events(spark, sf), "reg2j1b", "pT_lep1 < 50").select(KEY, "pT_lep1")


@query(
    "add_region",
    f"""{EV} SELECT event_id, CASE WHEN reg1j1b THEN '1j1b' WHEN reg2j1b THEN '2j1b' WHEN reg2j2b THEN '2j2b' END
    AS region FROM ev""",
)
def _(spark, sf):
    return frames.add_region(events(spark, sf)).select(KEY, "region")


_KINEMATICS = categorize_columns(EVENTS)["kinematics"]


@query("select_category", f"{EV} SELECT {cols(*_KINEMATICS)}, weight_nominal FROM ev")
def _(spark, sf):
    return frames.select_category(events(spark, sf), "kinematics")


@query(
    "select_category_weights",
    f"""{EV} SELECT weight_campaign, weight_nominal, weight_sys_noreweight, weight_sys_pileup_DOWN,
    weight_sys_pileup_UP, weight_tptrw_tool, weight_trrw_tool FROM ev""",
)
def _(spark, sf):
    return frames.select_category(events(spark, sf), "weights")


def _without(names, gone) -> str:
    return cols(*[n for n in names if n not in gone])


@query("drop_columns", f"{EV} SELECT {_without(EVENTS, {'score', 'campaign'})} FROM ev")
def _(spark, sf):
    return frames.drop_columns(events(spark, sf), "score", "campaign", "not_there")


@query("drop_avoid", f"{EV} SELECT {_without(EVENTS, {'E_jet1', 'pT_jet2'})} FROM ev")
def _(spark, sf):
    return frames.drop_avoid(events(spark, sf), "2j1b")


@query("drop_jet2", f"{EV} SELECT {_without(EVENTS, {'pT_jet2'})} FROM ev")
def _(spark, sf):
    return frames.drop_jet2(events(spark, sf))


@query("select_features", f"{WD} SELECT event_id, {cols(*features_for('2j2b'))} FROM ev")
def _(spark, sf):
    return frames.select_features(wide_events(spark, sf), "2j2b", extra=[KEY])


@query("select_features_all", f"{WD} SELECT event_id, {cols(*features_for('ALL'))} FROM ev")
def _(spark, sf):
    return frames.select_features(wide_events(spark, sf), "ALL", extra=[KEY])


_BINNING = [
    ("2j2b", "mass_lep1jet1", 25, 0.0, 250.0),
    ("2j2b", "pT_lep1", 20, 0.0, 100.0),
    ("2j2b", "not_a_column", 10, 0.0, 1.0),
    ("1j1b", "pT_lep1", 10, 0.0, 110.0),
]


@query(
    "with_variable_binning",
    f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{v}', {n}, {lo}::DOUBLE, {hi}::DOUBLE)" for r, v, n, lo, hi in _BINNING)})
      AS t(region, var, nbins, xmin, xmax)), ev AS ({EVENT_SQL})
    SELECT b.region, b.var, b.nbins, b.xmin, b.xmax, count(*) AS events FROM b, ev
    WHERE b.region = '2j2b' AND b.var <> 'not_a_column' AND ev.reg2j2b AND ev.OS = 1 GROUP BY ALL""",
)
def _(spark, sf):
    binning = spark.createDataFrame(_BINNING, "region string, var string, nbins int, xmin double, xmax double")
    df = events(spark, sf)
    chosen = frames.with_variable_binning(df, binning, "2j2b")
    counted = frames.select_region(df, "2j2b").agg(F.count(F.lit(1)).alias("events")).scalar()
    return chosen.withColumn("events", counted)


# --- weights --------------------------------------------------------------------

_FAMILY = ["weight_nominal", "weight_sys_pileup_UP", "weight_sys_pileup_DOWN", "weight_sys_noreweight"]


def _weights_sql(factor: str, operator: str = "*", kept=()) -> str:
    values = [f"{w} AS {w}" if w in kept else f"{w} {operator} {factor} AS {w}" for w in _FAMILY]
    return f"{EV} SELECT event_id, {cols(*values)} FROM ev"


def _weights(df):
    return df.select(KEY, *_FAMILY)


@query("apply_weight", _weights_sql("weight_trrw_tool", kept=["weight_sys_pileup_UP"]))
def _(spark, sf):
    return _weights(frames.apply_weight(events(spark, sf), "weight_trrw_tool", exclude=["weight_sys_pileup_UP"]))


@query("apply_weight_inverse", _weights_sql("nullif(weight_tptrw_tool, 0)", "/"))
def _(spark, sf):
    return _weights(frames.apply_weight_inverse(events(spark, sf), "weight_tptrw_tool"))


@query("apply_weight_campaign", _weights_sql("weight_campaign"))
def _(spark, sf):
    return _weights(frames.apply_weight_campaign(events(spark, sf)))


@query("apply_weight_tptrw", _weights_sql("weight_tptrw_tool", kept=["weight_sys_noreweight"]))
def _(spark, sf):
    return _weights(frames.apply_weight_tptrw(events(spark, sf)))


@query("apply_weight_trrw", _weights_sql("weight_trrw_tool", kept=["weight_sys_noreweight"]))
def _(spark, sf):
    return _weights(frames.apply_weight_trrw(events(spark, sf)))


@query(
    "clip_negative_weights",
    f"{EV} SELECT event_id, CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS weight_nominal FROM ev",
)
def _(spark, sf):
    return frames.clip_negative_weights(events(spark, sf)).select(KEY, "weight_nominal")


@query("scale_by_lumi", f"{EV} SELECT event_id, weight_nominal * 139.0 AS weight_nominal FROM ev")
def _(spark, sf):
    return frames.scale_by_lumi(events(spark, sf)).select(KEY, "weight_nominal")


@query(
    "normalize_region",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '2j2b' WHEN p_partkey % 4 = 1 THEN '1j1b'
      WHEN p_partkey % 4 = 2 THEN '2j1b' END AS region FROM part""",
)
def _(spark, sf):
    spelled = F.expr(
        "CASE p_partkey % 8 WHEN 0 THEN '2j2b' WHEN 4 THEN 'reg2j2b' WHEN 1 THEN 'r1j1b' WHEN 5 THEN 'reg1j1b' "
        "WHEN 2 THEN 'reg2j1b' WHEN 6 THEN '2j1b' WHEN 3 THEN '3j1b' ELSE p_brand END"
    )
    return table(spark, sf, "part").select("p_partkey", normalize_region(spelled).alias("region"))


# --- samples and splits ---------------------------------------------------------


@query("sample_fraction", f"{EV} SELECT event_id FROM ev WHERE {unit_sql()} < {int(round(0.6 * 2**32))}")
def _(spark, sf):
    return sampling.sample_fraction(events(spark, sf), 0.6, KEY).select(KEY)


@query(
    "sample_n_per_class",
    f"""{EV}, r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY {unit_sql()}, event_id) AS n FROM ev)
    SELECT event_id, label FROM r WHERE n <= 500""",
)
def _(spark, sf):
    return sampling.sample_n_per_class(events(spark, sf).select(KEY, "label"), 500, KEY)


@query(
    "train_test_split",
    f"""{EV} SELECT event_id, CASE WHEN {unit_sql()} < {int(round(0.4 * 2**32))} THEN 'test'
      WHEN {unit_sql(seed='414:valid')} < {int(round(0.2 * 2**32))} THEN 'valid' ELSE 'train' END AS split FROM ev""",
)
def _(spark, sf):
    return sampling.train_test_split(events(spark, sf), KEY, 0.4, validation_size=0.2).select(KEY, "split")


@query("kfold_assign", f"{EV} SELECT event_id, CAST({unit_sql()} % 3 AS INT) AS fold FROM ev")
def _(spark, sf):
    return sampling.kfold_assign(events(spark, sf), KEY).select(KEY, "fold")


# --- training tables ------------------------------------------------------------

_CLIP = "CASE WHEN {w} < 0 THEN 0 ELSE {w} END"


def _labelled(spark, sf):
    return frames.clip_negative_weights(events(spark, sf)).select(KEY, "label", F.col("weight_nominal").alias("weight"))


_LABELLED_SQL = f"{EV}, t AS (SELECT event_id, label, {_CLIP.format(w='weight_nominal')} AS weight FROM ev)"


@query(
    "scale_sum_weights",
    f"""{_LABELLED_SQL}, s AS (SELECT sum(weight) FILTER (label = 1) AS sig, sum(weight) FILTER (label = 0) AS bkg FROM t)
    SELECT event_id, label, round(CASE WHEN label = 1 THEN weight * (bkg / nullif(sig, 0)) ELSE weight END, 9) AS weight
    FROM t, s""",
)
def _(spark, sf):
    return rounded(prep.scale_sum_weights(_labelled(spark, sf)), 9, "weight")


@query(
    "normalize_mean_weight",
    f"""{_LABELLED_SQL}, s AS (SELECT sum(weight) AS total, count(*) AS n FROM t)
    SELECT event_id, label, round(weight * n / nullif(total, 0), 9) AS weight FROM t, s""",
)
def _(spark, sf):
    return rounded(prep.normalize_mean_weight(_labelled(spark, sf)), 9, "weight")


_FEATURES_2J2B = features_for("2j2b")


def _prepared_sql(signal: str, background: str, sig_w: str, bkg_w: str, bkg_extra: str = "", drop=()) -> str:
    kept = [f for f in _FEATURES_2J2B if f not in drop]
    return f"""{WD}, u AS (
      SELECT event_id, {cols(*kept)}, 1 AS label, {_CLIP.format(w=sig_w)} AS w FROM ev
        WHERE {signal} AND reg2j2b AND OS = 1
      UNION ALL SELECT event_id, {cols(*kept)}, 0 AS label, {_CLIP.format(w=bkg_w)} AS w FROM ev
        WHERE {background} AND reg2j2b AND OS = 1 {bkg_extra}),
    s AS (SELECT sum(w) FILTER (label = 1) AS sig, sum(w) FILTER (label = 0) AS bkg FROM u),
    v AS (SELECT u.*, CASE WHEN label = 1 THEN w * bkg / nullif(sig, 0) ELSE w END AS scaled FROM u, s),
    m AS (SELECT sum(scaled) AS total, count(*) AS n FROM v)
    SELECT event_id, {cols(*kept)}, label, round(scaled * n / nullif(total, 0), 8) AS weight FROM v, m"""


@query(
    "prepare_training",
    _prepared_sql(
        "process = 'tW_DR'",
        "process = 'ttbar'",
        "(weight_nominal * weight_campaign)",
        "(weight_nominal * weight_campaign * weight_tptrw_tool * weight_trrw_tool)",
        f"AND {unit_sql()} < {int(round(0.7 * 2**32))}",
    ),
)
def _(spark, sf):
    df = wide_events(spark, sf)
    prepared = prep.prepare_training(
        df.filter("process = 'tW_DR'"),
        df.filter("process = 'ttbar'"),
        "2j2b",
        key=KEY,
        weight_mean=1.0,
        use_campaign_weight=True,
        use_tptrw=True,
        use_trrw=True,
        background_fraction=0.7,
    )
    return rounded(prepared, 8, "weight")


@query(
    "save_and_load_prepared",
    _prepared_sql("process = 'tW_DR'", "process = 'ttbar'", "weight_nominal", "weight_nominal"),
)
def _(spark, sf):
    df = wide_events(spark, sf)
    prepared = prep.prepare_training(
        df.filter("process = 'tW_DR'"), df.filter("process = 'ttbar'"), "2j2b", key=KEY, weight_mean=1.0
    )
    folder = shared_folder(spark, "prepared")
    sources.save_prepared(prepared, folder, selection_for("2j2b"), "2j2b")
    table_, _ = sources.load_prepared(spark, folder)
    return rounded(table_, 8, "weight")


@query(
    "prepare_from_samples",
    _prepared_sql(
        "sample_group = 'tW_DR'",
        "sample_group = 'ttbar'",
        "weight_nominal",
        "weight_nominal",
        f"AND {unit_sql()} < {int(round(0.7 * 2**32))}",
    ),
)
def _(spark, sf):
    df = wide_events(spark, sf)

    def sample(name):
        table = frames.select_region(df.filter(F.col("sample_group") == name), "2j2b")
        return table.select(KEY, *_FEATURES_2J2B, "weight_nominal", "weight_sys_pileup_UP", "weight_campaign")

    prepared = prep.prepare_from_samples(
        sample("tW_DR"), sample("ttbar"), "2j2b", key=KEY, background_fraction="auto", weight_mean=1.0
    )
    return rounded(prepared, 8, "weight")


@query(
    "select_input_samples",
    _prepared_sql(
        "sample_group = 'tW_DR'",
        "sample_group IN ('ttbar_inc_AFII', 'ttbar_PS')",
        "weight_nominal",
        "(weight_nominal * weight_tptrw_tool)",
        drop=["mass_lep1jet2"],
    ),
)
def _(spark, sf):
    prepared = prep.select_input_samples(
        wide_events(spark, sf), "2j2b", multiple_ttbar=True, ignore=["mass_lep1jet2"], key=KEY, use_tptrw=True
    )
    return rounded(prepared, 8, "weight")
