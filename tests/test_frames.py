import pytest
from pyspark.sql import functions as F

from evq import config
from evq.operators import frames, prep, sampling
from evq.plans.views import events, wide_events


def weights(spark):
    return spark.createDataFrame(
        [("a", 0.003, 0.006, 0.5, 0.4, 0.98, 2.0), ("b", -0.002, 1.0, 1.0, 0.0, 0.5, 0.0)],
        "id string, weight_nominal double, weight_sys_jvt double, weight_sys_noreweight double, "
        "weight_campaign double, weight_tptrw_tool double, weight_trrw_tool double",
    )


def test_weight_family(spark):
    first = frames.apply_weight_campaign(weights(spark)).filter("id = 'a'").first()
    assert first["weight_nominal"] == pytest.approx(0.0012)
    assert first["weight_sys_jvt"] == pytest.approx(0.0024)
    assert first["weight_sys_noreweight"] == pytest.approx(0.2)
    assert first["weight_campaign"] == 0.4
    second = frames.apply_weight_tptrw(weights(spark), exclude=["weight_sys_jvt"]).filter("id = 'a'").first()
    assert second["weight_nominal"] == pytest.approx(0.00294)
    assert (second["weight_sys_jvt"], second["weight_sys_noreweight"]) == (0.006, 0.5)
    third = frames.apply_weight_trrw(weights(spark)).filter("id = 'a'").first()
    assert (third["weight_nominal"], third["weight_sys_noreweight"]) == (0.006, 0.5)
    # a weight never multiplies itself
    own = frames.apply_weight(weights(spark), "weight_sys_jvt").filter("id = 'a'").first()
    assert own["weight_sys_jvt"] == 0.006


def test_inverse_undoes_and_zero_gives_null(spark):
    df = weights(spark)
    back = frames.apply_weight_inverse(frames.apply_weight(df, "weight_tptrw_tool"), "weight_tptrw_tool")
    for got, want in zip(back.orderBy("id").collect(), df.orderBy("id").collect()):
        assert got["weight_nominal"] == pytest.approx(want["weight_nominal"])
    assert frames.apply_weight_inverse(df, "weight_trrw_tool").filter("id = 'b'").first()["weight_nominal"] is None


def test_clip_and_lumi(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (float("nan"),), (None,)], "weight_nominal double")
    got = [r[0] for r in frames.clip_negative_weights(df).collect()]
    assert got[:2] == [0.0, 2.0] and got[2] != got[2] and got[3] is None
    assert frames.scale_by_lumi(df).filter("weight_nominal > 0 AND NOT isnan(weight_nominal)").first()[0] == 278.0


def test_column_rules(spark, sf):
    df = wide_events(spark, sf)
    for region in config.SELECTIONS:
        kept = set(frames.drop_avoid(df, region).columns)
        assert not kept & set(config.AVOID) and not kept & set(config.AVOID_BY_REGION[region])
    before = list(config.AVOID)
    frames.drop_avoid(df, "2j1b")
    assert config.AVOID == before
    assert not [c for c in frames.drop_jet2(df).columns if "jet2" in c]
    assert frames.drop_columns(df, "score", "nothing").columns == [c for c in df.columns if c != "score"]
    with pytest.raises(ValueError, match="features"):
        frames.select_features(events(spark, sf), "1j1b")


def test_select_events_columns_and_errors(spark, sf):
    df = events(spark, sf)
    out = frames.select_events(df, "reg2j2b == 1 && OS == 1", columns=["pT_lep1", "E_jet1"], exclude_avoids=True)
    assert out.columns == ["pT_lep1", "weight_nominal"]  # columns of the selection are read, not kept
    with pytest.raises(ValueError, match="not in the table"):
        frames.select_events(df, "nope > 1", columns=["pT_lep1"])
    with pytest.raises(ValueError, match="key"):
        frames.select_events(df, "OS == 1", sample_fraction=0.5)


def test_select_events_plan_prunes_and_pushes(spark, sf, capsys):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_discount", "weight_nominal")
    frames.select_events(raw, "l_quantity < 10", columns=["l_tax"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in plan
    assert "Exchange" not in plan


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), float("nan"), 1)], "x double, weight_nominal double, n int")
    row = frames.nan_to_null(df).first()
    assert row["x"] is None and row["weight_nominal"] != row["weight_nominal"] and row["n"] == 1


def test_add_region(spark, sf):
    df = frames.add_region(events(spark, sf))
    for region in config.SELECTIONS:
        assert df.filter(F.col("region") == region).count() == df.filter(f"reg{region}").count()
    assert df.filter("region IS NULL").count() > 0


# --- samples and splits ---------------------------------------------------------


def ids(df):
    return sorted(r[0] for r in df.select("event_id").collect())


def test_samples_do_not_depend_on_partitions(spark, sf):
    df = events(spark, sf).select("event_id", "label")
    for operator in (
        lambda d: sampling.sample_fraction(d, 0.3, "event_id"),
        lambda d: sampling.sample_n_per_class(d, 50, "event_id"),
        lambda d: sampling.train_test_split(d, "event_id", 0.4).filter("split = 'test'"),
        lambda d: sampling.kfold_assign(d, "event_id", 3).filter("fold = 1"),
    ):
        assert ids(operator(df)) == ids(operator(df.repartition(7, "label")))


def test_sample_sizes(spark, sf):
    df = events(spark, sf)
    n = df.count()
    assert abs(sampling.sample_fraction(df, 0.3, "event_id").count() / n - 0.3) < 0.03
    both = sampling.sample_n_per_class(df, 50, "event_id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in both} == {0: 50, 1: 50}
    split = sampling.train_test_split(df, "event_id", 0.4, validation_size=0.2).groupBy("split").count().collect()
    shares = {r["split"]: r["count"] / n for r in split}
    assert shares["test"] == pytest.approx(0.4, abs=0.03) and shares["valid"] == pytest.approx(0.12, abs=0.02)
    folds = sampling.kfold_assign(df, "event_id", 5).select("fold").distinct().count()
    assert folds == 5


# --- training tables ------------------------------------------------------------


def test_prepare_training_sums(spark, sf):
    df = wide_events(spark, sf)
    sig, bkg = df.filter("process = 'tW_DR'"), df.filter("process = 'ttbar'")
    table = prep.prepare_training(sig, bkg, "2j2b", key="event_id", weight_mean=1.0)
    sums = {r["label"]: r["w"] for r in table.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[1] == pytest.approx(sums[0])
    assert table.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    assert table.columns == ["event_id", *config.FEATURES["2j2b"], "label", "weight"]
    assert table.filter("weight < 0").count() == 0
    scaled = prep.prepare_training(sig, bkg, "2j2b", weight_scale=2.0)
    plain = prep.prepare_training(sig, bkg, "2j2b")
    total = [t.agg(F.sum("weight")).first()[0] for t in (scaled, plain)]
    assert total[0] == pytest.approx(2 * total[1])
    raw = prep.prepare_training(sig, bkg, "2j2b", scale_sums=False)
    sums = {r["label"]: r["w"] for r in raw.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[1] != pytest.approx(sums[0])


def test_prepare_training_errors(spark, sf):
    df = wide_events(spark, sf)
    with pytest.raises(ValueError, match="exclude"):
        prep.prepare_training(df, df, "2j2b", weight_mean=1.0, weight_scale=1.0)
    with pytest.raises(ValueError, match="exclude"):
        prep.prepare_from_samples(df, df, "2j2b", background_fraction=0.5, n_per_class=3)
    with pytest.raises(ValueError, match="differ"):
        prep.prepare_from_samples(
            df.select("pT_lep1", "weight_nominal"), df.select("pT_jet2", "weight_nominal"), "2j2b"
        )
    with pytest.raises(ValueError, match="key"):
        prep.prepare_training(df, df, "2j2b", n_per_class=5)


def test_prepare_n_per_class(spark, sf):
    df = wide_events(spark, sf)
    table = prep.prepare_training(
        df.filter("process = 'tW_DR'"), df.filter("process = 'ttbar'"), "2j2b", key="event_id", n_per_class=20
    )
    assert {r["label"]: r["count"] for r in table.groupBy("label").count().collect()} == {0: 20, 1: 20}


def test_input_groups():
    assert prep.input_groups() == (["tW_DR"], ["ttbar"])
    assert prep.input_groups("DS", dilepton=False) == (["tW_DS_inc"], ["ttbar_inc"])
    assert prep.input_groups(multiple_ttbar=True) == (["tW_DR"], ["ttbar_inc_AFII", "ttbar_PS"])
    assert prep.input_groups(inclusive_afii=True) == (["tW_DR_inc_AFII"], ["ttbar_inc_AFII"])


def test_normalisation_stays_lazy_without_cross_join(spark, sf, capsys):
    df = wide_events(spark, sf)
    prep.prepare_training(df, df, "2j2b", weight_mean=1.0).explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
