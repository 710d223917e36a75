import os

import pytest
from pyspark.sql import functions as F

from evq import config
from evq.functions.fit_keys import FitKey
from evq.operators import fits as operators
from evq.plans.session import ensure_checkpoint_dir
from evq.plans.views import wide_events
from evq.sources import events as sources
from evq.sources import fits

GOOD = {
    "ttbar_410472_AFII_MC16d_nominal.root": ("ttbar", 410472, "AFII", "MC16d", "nominal"),
    "ttbar_410472_AFII_MC16e_EG_SCALE_ALL__1up": ("ttbar", 410472, "AFII", "MC16e", "EG_SCALE_ALL__1up"),
    "tW_DS_410657_FS_MC16d_EG_RESOLUTION_ALL__1down": ("tW_DS", 410657, "FS", "MC16d", "EG_RESOLUTION_ALL__1down"),
    "Diboson_364255_FS_MC16e_nominal.root": ("Diboson", 364255, "FS", "MC16e", "nominal"),
    "Data17_data17_Data_Data_nominal.root": ("Data", 0, "Data", "Data", "nominal"),
    "MCNP_Zjets_364137_FS_MC16a_nominal.root": ("MCNP", 364137, "FS", "MC16a", "nominal"),
    "tW_DR_410648_AFII_MC16d_nominal.bdtresp.npy": ("tW_DR", 410648, "AFII", "MC16d", "nominal"),
}


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_sample_info(spark):
    for row in sources.sample_info(names(spark, GOOD)).collect():
        assert tuple(row)[1:6] == GOOD[row["name"]] and row["is_valid"]
    bad = sources.sample_info(names(spark, ["tW_DR_410_bad"]))
    row = bad.first()
    assert tuple(row)[1:] == (None, None, None, None, None, False)
    with pytest.raises(Exception, match="tW_DR_410_bad is not a sample file name"):
        sources.require_valid(bad).collect()
    assert sources.require_valid(sources.sample_info(names(spark, GOOD))).count() == len(GOOD)


def test_sample_group(spark):
    files = {}
    for group, (process, dsid, sim) in config.SAMPLE_GROUPS.items():
        files[f"{process}_{dsid.split('|')[-1].replace('[0-9]{6}', '364255')}_{sim}_MC16d_nominal.root"] = group
    files["Data17_data17_Data_Data_nominal.root"] = "Data"
    files["Data15_data15_Data_Data_nominal.root"] = "Data"
    files["MCNP_Zjets_364137_FS_MC16a_nominal.root"] = None
    files["ttbar_410472_FS_MC16d_EG_SCALE_ALL__1up.root"] = None
    files["ttbar_410472_FS_MC16d_nominal.root.part"] = None
    files["prefix_ttbar_410472_FS_MC16d_nominal.root"] = None
    got = {r["name"]: r["sample_group"] for r in sources.sample_group(names(spark, files)).collect()}
    assert got == files
    one = {r["name"]: r["sample_group"] for r in sources.sample_group(names(spark, files), campaign="MC16d").collect()}
    assert one["Data17_data17_Data_Data_nominal.root"] == "Data"
    assert one["Data15_data15_Data_Data_nominal.root"] is None
    assert one["ttbar_410472_FS_MC16d_nominal.root"] == "ttbar"
    other = {r["name"]: r["sample_group"] for r in sources.sample_group(names(spark, files), campaign="MC16a").collect()}
    assert other["ttbar_410472_FS_MC16d_nominal.root"] is None
    with pytest.raises(ValueError):
        sources.sample_group(names(spark, files), campaign="MC20")
    tree = sources.sample_group(names(spark, files), tree="EG_SCALE_ALL__1up").filter("sample_group IS NOT NULL")
    assert [r["sample_group"] for r in tree.collect()] == ["ttbar"]


def touch(folder, *files):
    for name in files:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").close()


def test_listing(spark, folder):
    touch(folder, "ttbar_410472_FS_MC16e_nominal.root", "ttbar_410472_FS_MC16a_nominal.root", "readme.txt")
    found = sources.sample_files(spark, folder)
    assert [p.rsplit("/", 1)[-1] for p in found["ttbar"]] == [
        "ttbar_410472_FS_MC16a_nominal.root",
        "ttbar_410472_FS_MC16e_nominal.root",
    ]
    assert found["Data"] == [] and set(found) == {*config.SAMPLE_GROUPS, "Data"}


def test_read_events(spark, folder):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "pT double, Eta double, weight_nominal double, weight_sys_a double")
    df.write.parquet(f"{folder}/a.parquet")
    df.write.parquet(f"{folder}/b.parquet")
    both = sources.read_events(spark, [f"{folder}/a.parquet", f"{folder}/b.parquet"])
    assert both.columns == ["Eta", "pT", "weight_nominal", "weight_sys_a"] and both.count() == 2
    slim = sources.read_events(spark, f"{folder}/a.parquet", ["pT"])
    assert slim.columns == ["pT", "weight_nominal"]
    assert sources.read_events(spark, f"{folder}/a.parquet", drop_weight_sys=True).columns == ["Eta", "pT", "weight_nominal"]
    with pytest.raises(ValueError, match="weight_other"):
        sources.read_events(spark, f"{folder}/a.parquet", weight_name="weight_other")
    with pytest.raises(ValueError, match="nope"):
        sources.read_events(spark, f"{folder}/a.parquet", ["nope"])
    assert sources.read_events(spark, f"{folder}/a.parquet", ["pT"], file_name=True).first()["file_name"].endswith(".parquet")


def test_region_samples_round_trip(spark, sf, folder):
    df = wide_events(spark, sf).withColumn("minimaxmbl", F.lit(1.0)).withColumn("eta_met", F.lit(float("nan")))
    written = sources.write_region_samples(df, f"{folder}/samples")
    for region in written:
        back = sources.read_region_sample(spark, f"{folder}/samples", region)
        gone = {*config.AVOID, *config.AVOID_BY_REGION[region], *config.ALWAYS_DROP[region]}
        assert not gone & set(back.columns)
        assert ("minimaxmbl" in back.columns) == (region != "1j1b")
        assert any("jet2" in c for c in back.columns) == (region != "1j1b")
        want = df.filter(f"reg{region} AND OS = 1 AND sample_group IN ('tW_DR', 'tW_DS', 'ttbar')")
        counts = lambda t: {r["sample_group"]: r["count"] for r in t.groupBy("sample_group").count().collect()}
        assert counts(back) == counts(want)
    with pytest.raises(Exception, match="already exists"):
        sources.write_region_samples(df, f"{folder}/samples")


def test_region_samples_are_one_scan(spark, sf, folder, monkeypatch):
    df = wide_events(spark, sf).withColumn("reg1j1b", F.lit(True)).withColumn("weight_campaign", F.lit(2.0))  # many events in two regions
    plans, write = [], type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or write(self, *a, **k))
    sources.write_region_samples(df, f"{folder}/one", use_campaign_weight=True)
    assert len(plans) == 1 and plans[0].count("Relation [") == 1
    for region in ("1j1b", "2j2b"):
        want = sources.region_sample(df.filter("sample_group IN ('tW_DR', 'tW_DS', 'ttbar')"), region, True, key="sample_group")
        back = sources.read_region_sample(spark, f"{folder}/one", region)
        assert back.columns == want.columns
        total = lambda t: tuple(t.agg(F.count(F.lit(1)), F.round(F.sum("weight_nominal"), 6)).first())
        assert total(back) == total(want)
    raw = spark.read.parquet(f"{folder}/one")
    assert raw.filter("region = '1j1b' AND pT_jet2 IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="no region"):
        sources.read_region_sample(spark, f"{folder}/one", "3j1b")


def test_prepared_round_trip(spark, folder):
    df = spark.createDataFrame([(1.0, 1, 0.5), (2.0, 0, 1.5)], "x double, label int, weight double")
    sources.save_prepared(df, f"{folder}/p", "(a == True)", "2j2b", "DS", ["s.root"], ["b1.root", "b2.root"])
    back, about = sources.load_prepared(spark, f"{folder}/p")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert about == {
        "selection_used": "(a == True)",
        "region": "2j2b",
        "nlo_method": "DS",
        "signal_files": ["s.root"],
        "background_files": ["b1.root", "b2.root"],
    }


# --- fit results ----------------------------------------------------------------

FIT = """NUISANCE_PARAMETERS
3
alpha_JET   0.12 0.9 -0.95
alpha_BAD nan -Inf +infinity
SigXsecOverSM 1.01  0.1 -0.09
gamma_stat_r1_bin_0 1.0 0.01 -0.01

CORRELATION_MATRIX
4 4
1.0 0.1 0.2 0.3
NLL
12345.678
"""


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_fit_params(spark, folder):
    write(folder, "Fits/tW.txt", FIT)
    write(folder, "Fits/tW_exclude-NP_1.txt", "H\n1\nSigXsecOverSM 0.99 .2 -2e-1\n")
    rows = fits.read_fit_params(spark, folder).collect()
    assert all(r["fit"]["workspace"].endswith(folder) for r in rows)
    got = {(r["fit"]["file"], r["name"]): (r["central"], r["sig_hi"], r["sig_lo"]) for r in rows}
    bad = got.pop(("tW", "alpha_BAD"))
    assert bad[0] != bad[0] and bad[1:] == (float("-inf"), float("inf"))
    assert got == {
        ("tW", "alpha_JET"): (0.12, 0.9, -0.95),
        ("tW", "SigXsecOverSM"): (1.01, 0.1, -0.09),
        ("tW_exclude-NP_1", "SigXsecOverSM"): (0.99, 0.2, -0.2),
    }


def test_np_ranking(spark, folder):
    write(folder, "Fits/NPRanking_ttbar_PS.txt", "ttbar_PS 0.12345678 0.9 -0.8  0.05 -0.06 0.07 -0.08\n")
    row = fits.read_np_ranking(spark, folder).first().asDict()
    assert row.pop("fit").endswith(folder)
    assert row == {
        "name": "ttbar_PS", "central": 0.123457, "sig_hi": 0.9, "sig_lo": -0.8, "post_up": 0.05,
        "post_down": -0.06, "pre_up": 0.07, "pre_down": -0.08,
    }


def test_grouped_impacts(spark, folder):
    write(folder, "Fits/GroupedImpact.txt", "Gammas 0.05 ( +0.05, -0.04 )\nJet_Energy 0.1 ( +0.11, -0.09 )\nFullSyst 1 ( +1, -1 )\n")
    rows = sorted(tuple(r) for r in fits.read_grouped_impacts(spark, folder).drop("fit").collect())
    assert rows == [("Jet Energy", 0.1, -0.09, 0.11), ("Statistics", 0.05, -0.04, 0.05)]
    assert fits.read_grouped_impacts(spark, folder, include_total=True).count() == 3


def test_chi2(spark, folder):
    write(folder, "Histograms/reg1j1b_preFit_Chi2.txt", "chi2: 12.5\nndof: 10\nprobability: 0.25\n")
    write(folder, "Histograms/reg1j1b_postFit_Chi2.txt", "  chi2: 2.5\n  ndof: 10\n  probability: 0.99\nextra: x\n")
    rows = sorted(tuple(r) for r in fits.read_chi2(spark, folder).drop("fit").collect())
    assert rows == [("reg1j1b", "post", 2.5, 10, 0.99), ("reg1j1b", "pre", 12.5, 10, 0.25)]


def test_several_workspaces_stay_apart(spark, folder):
    for ws, post in (("tW", "0.05"), ("other", "0.5")):
        write(folder, f"{ws}/Fits/NPRanking_JET.txt", f"JET 0.1 0.9 -0.8 {post} -0.06 0.07 -0.08\n")
        write(folder, f"{ws}/Fits/NPRanking_MET.txt", "MET 0.2 0.7 -0.6 0.01 -0.02 0.03 -0.04\n")
        write(folder, f"{ws}/Fits/GroupedImpact.txt", f"JET {post} ( +0.1, -0.1 )\n")
        write(folder, f"{ws}/Histograms/r_preFit_Chi2.txt", f"chi2: {post}\nndof: 4\nprobability: 0.5\n")
    touch(folder, "tW/Histograms/r_preFit.root", "tW/Histograms/r_postFit.root", "other/Histograms/r_preFit.root")
    name = lambda fit: fit.rpartition("/")[2]
    ranking = fits.read_np_ranking(spark, folder)
    top = {(name(r["fit"]), r["name"]): r["post_max"] for r in operators.top_impacts(operators.np_impacts(ranking), 1).collect()}
    assert top == {("tW", "JET"): 0.06, ("other", "JET"): 0.5}
    pulls = operators.compare_nuispar(ranking.withColumn("fit", F.element_at(F.split("fit", "/"), -1)), "tW", "other")
    assert {r["name"] for r in pulls.collect()} == {"JET", "MET"}
    assert {(name(r["fit"]), r["avg"]) for r in fits.read_grouped_impacts(spark, folder).collect()} == {("tW", 0.05), ("other", 0.5)}
    assert {(name(r["fit"]), r["chi2"], r["ndof"]) for r in fits.read_chi2(spark, folder).collect()} == {("tW", 0.05, 4), ("other", 0.5, 4)}
    assert {(name(r["fit"]), r["has_postfit"]) for r in fits.fit_inventory(sources.list_files(spark, folder)).collect()} == {("tW", True), ("other", False)}


def test_fits_of_one_name_in_two_workspaces(spark, folder):
    for ws, central in (("v1", "1.0"), ("v2", "1.5")):
        write(folder, f"{ws}/Fits/tW.txt", f"H\n1\n  SigXsecOverSM\t{central} 0.3 -0.4 \nJET 0.5 1 -1\nx -nan +NaN nan\n1.0 2 3 4\na b c\nw 1 2 x\n")
        write(folder, f"{ws}/Fits/tW_exclude-JET.txt", f"SigXsecOverSM {central}5 0.4 -0.3\n")
        write(folder, f"{ws}/Fits/GroupedImpact.txt", f"b_x {central} ( +0.1, -0.1 )\nA 0.{ws[1]} ( +0.1, -0.1 )\n")
    params = fits.read_fit_params(spark, folder)
    assert params.filter("name = 'x' AND isnan(central) AND isnan(sig_hi) AND isnan(sig_lo)").count() == 2 and params.count() == 8
    root = params.filter("fit.file = 'tW'").first()["fit"]["workspace"].rpartition("/")[0]
    one, two = FitKey(f"{root}/v1", "tW"), FitKey(f"{root}/v2", "tW")
    delta = operators.delta_poi(params, one, two).first()
    assert (delta["delta"], delta["delta_up"]) == (pytest.approx(-0.5), pytest.approx(0.3 * 2**0.5))
    assert {r["which"] for r in operators.compare_uncertainty(params, one, FitKey(two.workspace, "tW_exclude-JET")).filter("quantity = 'down'").collect()} == {str(one)}
    left_out = [(r["workspace"][-2:], r["excluded"], round(r["delta"], 9)) for r in operators.excluded_systematics_delta(params).collect()]
    assert left_out == [("v1", "JET", -0.05), ("v2", "JET", -0.05)]
    configs = spark.createDataFrame([("17", "new", two), ("18", "old", one)], "config string, label string, fit struct<workspace:string,file:string>")
    assert [(r["label"], r["delta"]) for r in operators.campaign_delta(params, configs, one).collect()] == [("new", -0.5)]
    systematics = spark.createDataFrame([("JET", "jets", "Jets")], "name string, category string, title string")
    pulls = operators.pulls_by_category(params, systematics, keep=["fit"]).collect()
    assert sorted(r["fit"]["workspace"][-2:] for r in pulls) == ["v1", "v2"]
    for descending, order in ((False, ["A", "b x"]), (True, ["b x", "A"])):
        table = operators.grouped_impact_table(fits.read_grouped_impacts(spark, folder), descending).collect()
        assert [(r["fit"][-2:], r["position"], r["name"]) for r in table] == [(ws, i, n) for ws in ("v1", "v2") for i, n in enumerate(order)]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_region_samples_are_few_files(spark, sf, folder):
    df = wide_events(spark, sf).repartition(40)
    for path in sources.write_region_samples(df, f"{folder}/few").values():
        assert len(spark.read.parquet(path).inputFiles()) <= 6


def test_inventory(spark, folder):
    touch(
        folder, "Histograms/a_preFit.root", "Histograms/a_postFit.root", "Histograms/b_preFit.root",
        "Histograms/asimov_c_preFit.root", "Histograms/d_postFit.root", "Histograms/a_preFit_Chi2.txt",
    )
    files = sources.list_files(spark, folder)
    assert {r["region"]: r["has_postfit"] for r in fits.fit_inventory(files).collect()} == {"a": True, "b": False}
    assert fits.postfit_available(files).first()["postfit"]
    assert not fits.postfit_available(files.filter("name LIKE 'b%'")).first()["postfit"]
