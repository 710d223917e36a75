import pytest
from pyspark.sql import functions as F

from evq.functions import text
from evq.operators import fits
from evq.plans.positions import with_position
from evq.plans.session import ensure_checkpoint_dir

SCHEMA = "fit string, name string, central double, sig_hi double, sig_lo double, pre_up double, pre_down double, post_up double, post_down double"


@pytest.fixture()
def params(spark):
    rows = [
        ("a", "SigXsecOverSM", 1.1, 0.3, -0.4, 0.0, 0.0, 0.0, 0.0),
        ("b", "SigXsecOverSM", 1.0, 0.4, -0.3, 0.0, 0.0, 0.0, 0.0),
        ("a", "NP_1", 0.5, 0.9, -0.8, 0.2, -0.1, 0.10, -0.20),
        ("b", "NP_1", 0.1, 0.8, -0.9, 0.1, -0.2, 0.05, -0.10),
        ("a", "NP_2", 0.0, 1.0, -1.0, 0.3, -0.3, -0.25, 0.0),
        ("a", "NP_3", 0.0, 1.0, -1.0, 0.3, -0.3, 0.20, 0.10),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_impacts(params):
    a = params.filter("fit = 'a'")
    assert [r["name"] for r in fits.np_impacts(a).collect()] == ["SigXsecOverSM", "NP_1", "NP_3", "NP_2"]
    top = fits.top_impacts(params, 2).filter("fit = 'a'").orderBy("rank").collect()
    assert [r["name"] for r in top] == ["NP_2", "NP_1"]
    bars = fits.impact_bars(params, 3).filter("fit = 'a'").orderBy("ys").collect()
    assert [(r["ys"], r["name"]) for r in bars] == [(0, "NP_3"), (1, "NP_1"), (2, "NP_2")]
    assert bars[2]["post_up_left"] == -0.25 and bars[2]["post_down_left"] == 0.0 and bars[2]["label"] == "NP 2"
    every = fits.impact_bars(params, None).filter("fit = 'a'").orderBy("ys").collect()
    assert [(r["ys"], r["name"]) for r in every] == [(0, "SigXsecOverSM"), (1, "NP_3"), (2, "NP_1"), (3, "NP_2")]


def test_delta(params):
    row = fits.delta_poi(params, "a", "b").first()
    assert row["delta"] == pytest.approx(0.1)
    assert row["delta_up"] == pytest.approx(0.5) and row["delta_down"] == pytest.approx(0.5)
    assert sorted(r["name"] for r in fits.delta_param(params, "a", "b").collect()) == ["NP_1", "SigXsecOverSM"]
    assert fits.delta_poi(params, "a", "b", poi="NP_2").count() == 0


def test_compare(params):
    got = {(r["name"], r["quantity"]): (r["which"], r["change"]) for r in fits.compare_uncertainty(params, "a", "b").collect()}
    assert got["SigXsecOverSM", "up"] == ("b", pytest.approx(100 / 3))
    assert got["SigXsecOverSM", "down"] == ("a", pytest.approx(100 / 3))
    nps = {r["quantity"]: r for r in fits.compare_nuispar(params.filter("name = 'NP_1'"), "a", "b").collect()}
    assert (nps["sig_lo"]["which"], nps["sig_lo"]["change"]) == ("a", pytest.approx(0.1))
    assert (nps["sig_hi"]["which"], nps["sig_hi"]["change"]) == ("b", pytest.approx(0.1))
    assert (nps["pre_up"]["which"], nps["pre_up"]["change"]) == ("a", pytest.approx(100.0))
    assert (nps["pre_down"]["which"], nps["pre_down"]["change"]) == ("b", pytest.approx(100.0))
    assert (nps["post_up"]["which"], nps["post_up"]["change"]) == ("a", pytest.approx(100.0))
    summary = fits.comparison_summary(params, "a", "b", nuispars=["NP_1"])
    assert summary.count() == 8
    zero = fits.compare_nuispar(params.filter("name = 'SigXsecOverSM'"), "a", "b").filter("quantity = 'pre_up'").first()
    assert zero["change"] is None


def test_one_scan_for_a_pair(params, spark, folder, capsys):
    params.write.parquet(f"{folder}/fits")
    fits.compare_nuispar(spark.read.parquet(f"{folder}/fits"), "a", "b").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 2 and "Join" not in plan  # tree and details name the one scan


def test_against_nominal(spark):
    rows = [
        ("tW", "SigXsecOverSM", 1.0, 0.3, -0.3),
        ("tW_exclude-b_NP", "SigXsecOverSM", 0.9, 0.4, -0.4),
        ("tW_exclude-A_ttbar", "SigXsecOverSM", 1.2, 0.4, -0.4),
        ("tW_exclude-saturatedModel_x", "SigXsecOverSM", 7.0, 0.4, -0.4),
        ("tW_exclude-A_ttbar", "NP", 7.0, 0.4, -0.4),
        ("main17", "SigXsecOverSM", 1.5, 0.4, -0.4),
        ("main1j", "SigXsecOverSM", 0.5, 0.4, -0.4),
    ]
    df = spark.createDataFrame(rows, "fit string, name string, central double, sig_hi double, sig_lo double")
    got = fits.excluded_systematics_delta(df).collect()
    assert [r["excluded"] for r in got] == ["A_ttbar", "b_NP"]
    assert got[0]["label"] == r"A $t\bar{t}$"
    assert [r["delta"] for r in got] == pytest.approx([-0.2, 0.1])
    assert got[0]["delta_up"] == pytest.approx(0.5)
    configs = spark.createDataFrame(
        [("main", "Complete", "tW"), ("17", "2017", "main17"), ("1j1b", "1j1b only", "main1j")], "config string, label string, fit string"
    )
    assert [(r["label"], r["delta"]) for r in fits.campaign_delta(df, configs, "tW").collect()] == [("2017", -0.5)]
    assert [(r["label"], r["delta"]) for r in fits.region_delta(df, configs, "tW").collect()] == [("1j1b only", 0.5)]
    pulls = {r["label"]: r["central"] for r in fits.param_pulls_by_config(df, configs, "SigXsecOverSM").collect()}
    assert pulls == {"Complete": 1.0, "2017": 1.5, "1j1b only": 0.5}


def test_impact_across_configs(params, spark):
    configs = spark.createDataFrame([("1", "h704", "a"), ("2", "h713", "b")], "config string, label string, fit string")
    rows = fits.impact_across_configs(params, configs, ["NP_1"]).orderBy("ys").collect()
    assert [(r["ys"], r["label"], r["post_max"]) for r in rows] == [(0, "h704 NP 1", 0.2), (1, "h713 NP 1", 0.1)]
    rows = fits.impact_across_configs(params, configs, ["NP_1"], sort=True).orderBy("ys").collect()
    assert [r["label"] for r in rows] == ["h713 NP 1", "h704 NP 1"]


def test_grouped_table(spark):
    df = spark.createDataFrame([("w", "b", 0.1234), ("w", "A", 0.2), ("w", "c", 0.3)], "fit string, name string, avg double")
    assert [(r["name"], round(r["impact"], 6)) for r in fits.grouped_impact_table(df).collect()] == [("A", 20.0), ("b", 12.3), ("c", 30.0)]
    assert [r["name"] for r in fits.grouped_impact_table(df, descending=True).collect()] == ["c", "A", "b"]


def test_pulls_by_category(params, spark):
    systematics = spark.createDataFrame([("NP_1", "jets", "JES"), ("NP_9", "jets", "JER")], "name string, category string, title string")
    rows = fits.pulls_by_category(params, systematics, keep=["fit"]).orderBy("fit").collect()
    assert [(r["fit"], r["category"], r["mean"], r["plus"], r["minus"]) for r in rows] == [
        ("a", "jets", 0.5, 0.9, -0.8),
        ("b", "jets", 0.1, 0.8, -0.9),
    ]


def test_positions_of_a_hot_group(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("k"),
        (F.col("id") * 7919 % 11).alias("v"),
        "id",
    )
    placed = with_position(df, ["k"], [F.col("v"), F.col("id").desc()], "at", F.col("v"))
    rows = placed.filter("k = 'hot'").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(14_000))
    assert [(r["v"], -r["id"]) for r in rows] == sorted((r["v"], -r["id"]) for r in rows)
    assert placed.count() == 20_000


def test_positions_need_no_files(spark, capsys):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1000).alias("v"), "id").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    placed = with_position(df, ["k"], [F.col("v"), F.col("id")], "at", F.col("v"))
    rows = placed.collect()
    for k in (None, 1, 2):  # null keys and null values have their places too
        group = sorted((r for r in rows if r["k"] == k), key=lambda r: r["at"])
        assert [r["at"] for r in group] == list(range(len(group))) and len(group) > 1600
        assert [(r["v"] is not None, r["v"] or 0, r["id"]) for r in group] == sorted((r["v"] is not None, r["v"] or 0, r["id"]) for r in group)
    assert with_position(df.limit(0), ["k"], [F.col("v")], "at", F.col("v")).count() == 0
    placed.explain("formatted")
    plan = capsys.readouterr().out
    assert "RDD" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # Both branches see the same split points: the subquery is evaluated once.
    placed.count()
    executed = placed._jdf.queryExecution().executedPlan().toString()
    assert executed.count("ReusedSubquery") >= 1


def test_checkpoint_dir_is_kept(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "label, pretty",
    [
        ("tW_DRDS_norm", r"$tW$ DR vs DS norm"),
        ("ttbar_AR_muF", r"$t\bar{t}$ $\mu_F$"),
        ("ttbar_hdamp", r"$t\bar{t}$ $h_{\mathrm{damp}}$"),
        ("JET_EffectiveNP_RhoT", "JET Eff. NP Rho T"),
        ("MET_ptreweight", r"$E_{\mathrm{T}}^{\mathrm{miss}}$ top-$p_{\mathrm{T}}$-reweight"),
    ],
)
def test_prettify_label(spark, label, pretty):
    assert one(spark, text.prettify_label(F.lit(label))) == pretty


def test_texts(spark):
    meta = text.meta_text(F.lit("reg2j1b_pt"), F.lit("post"))
    assert one(spark, meta) == "$tW$ Dilepton, 2j1b, Post-fit"
    assert one(spark, text.meta_text(F.lit("reg9"), F.lit("post"))) is None
    assert one(spark, text.meta_text(F.lit("1j1b"), F.lit("mid"))) is None
    chi2 = text.chisq_text(F.lit(12.345), F.lit(10), F.lit(0.254))
    assert one(spark, chi2) == r"$\chi^2/\mathrm{ndf} = 12.35 / 10$, $\chi^2_{\mathrm{prob}} = 0.25$"
    assert one(spark, text.log_scale_flag(F.lit("VRP_genericMT2"))) and not one(spark, text.log_scale_flag(F.lit("genericMT2_x")))


def test_axis_label(spark):
    titles = spark.createDataFrame([("met", "MET", "GeV"), ("bdt", "BDT", None)], "name string, mpl string, unit string")
    df = spark.createDataFrame(
        [("reg2j2b_VRP_met", 20.0), ("met", 2.5), ("bdt", 0.05), ("bdt", 1.0), ("other", 1.0)], "region string, bin_width double"
    )
    got = {(r["region"], r["bin_width"]): (r["x_label"], r["y_label"]) for r in text.axis_label(df, titles).collect()}
    assert got == {
        ("reg2j2b_VRP_met", 20.0): ("MET [GeV]", "Events/20 GeV"),
        ("met", 2.5): ("MET [GeV]", "Events/2.50 GeV"),
        ("bdt", 0.05): ("BDT", "Events/0.05"),
        ("bdt", 1.0): ("BDT", "Events/1"),
        ("other", 1.0): (None, None),
    }
