import pytest
from pyspark.sql import types as T

from evq import config
from evq.functions import regions
from evq.functions.selections import (
    selection_as_numexpr,
    selection_as_root,
    selection_columns,
    selection_for,
    selection_sql,
)
from evq.operators import frames

NUMEXPR = "(reg1j1b == True) & (OS == True) & (mass_lep1jet1 < 155)"
ROOT = "reg1j1b == true && OS == true && mass_lep1jet1 < 155"

SCHEMA = T.StructType(
    [
        T.StructField("flag", T.BooleanType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def rows(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [(True, 1, 1.0, 2.0), (False, 1, 3.0, nan), (True, 0, nan, 1.0), (False, 0, 5.0, 5.0), (True, 2, -4.0, 0.0)],
        SCHEMA,
    )


def test_dialects():
    assert selection_as_numexpr(ROOT) == NUMEXPR
    assert selection_as_numexpr(NUMEXPR) == NUMEXPR
    assert selection_as_root(NUMEXPR) == "(reg1j1b == true) && (OS == true) && (mass_lep1jet1 < 155)"
    assert selection_as_root(selection_as_root(NUMEXPR)) == selection_as_root(NUMEXPR)
    assert selection_as_numexpr("x < 1") == "x < 1"
    assert selection_as_root("~flag & (x > 1)") == "!flag && (x > 1)"


def test_columns():
    assert selection_columns(NUMEXPR) == selection_columns(ROOT) == {"reg1j1b", "OS", "mass_lep1jet1"}
    assert selection_columns("abs(eta) < 2.5 || !isGood") == {"eta", "isGood"}


def test_selection_for():
    assert selection_for("reg2j1b") == config.SELECTIONS["2j1b"]
    assert selection_for(regions.Region.r2j2b) == config.SELECTIONS["2j2b"]
    assert selection_for("2j2b", "minimaxmbl < 155") == "((reg2j2b == True) & (OS == True)) & (minimaxmbl < 155)"
    assert selection_for("r1j1b", "a < 155 && b < 155").endswith(" & ((a < 155) & (b < 155))")
    with pytest.raises(ValueError):
        selection_for("3j1b")
    with pytest.raises(ValueError):
        selection_for(regions.Region.rUnkn)


@pytest.mark.parametrize(
    "text",
    [
        "n == 1 & x < 155",
        "missing > 1",
        "n == 1 &&",
        "&& n == 1",
        "(n == 1",
        "n == 1)",
        "n @ 1",
        "flag == 3",
        "",
        "!",
    ],
)
def test_bad_selections(text):
    with pytest.raises(ValueError):
        selection_sql(text, SCHEMA)


@pytest.mark.parametrize(
    "text, kept",
    [
        ("flag == 1", {0, 2, 4}),
        ("flag == 0", {1, 3}),
        ("flag != true", {1, 3}),
        ("n == true", {0, 1}),
        ("n", {0, 1, 4}),
        ("!n", {2, 3}),
        ("flag && n", {0, 4}),
        ("~flag | (n == 2)", {1, 3, 4}),
        ("x > 2", {1, 3}),  # NaN passes no comparison
        ("2 < x", {1, 3}),
        ("!(x > 2)", {0, 2, 4}),
        ("x < y", {0, 4}),
        ("x >= y", {3}),
        ("x == y", {3}),
        ("abs(x) >= 4 && (x + y) < 7", {4}),
        ("n == flag", {0, 3}),
        ("!flag || !(n == 1 && x < 2)", {1, 2, 3, 4}),
        ("((flag)) && (((x < 2)))", {0, 4}),
        ("x > -5 && x < 0", {4}),
        ("x > 1e0", {1, 3}),
    ],
)
def test_truth_table(spark, text, kept):
    table = rows(spark).collect()
    got = frames.where_selection(rows(spark), text).collect()
    key = lambda r: (r["flag"], r["n"], str(r["x"]), str(r["y"]))
    assert {key(r) for r in got} == {key(table[i]) for i in kept}


def test_four_spellings_agree(spark, sf):
    from evq.plans.views import events

    df = events(spark, sf)
    texts = [
        "OS == 1 && reg2j2b == 1 && mass_lep1jet1 < 155",
        "(OS == 1) & (reg2j2b == 1) & (mass_lep1jet1 < 155)",
        "OS == true && reg2j2b == true && mass_lep1jet1 < 155",
        "(OS == True) & (reg2j2b == True) & (mass_lep1jet1 < 155)",
    ]
    kept = [sorted(r[0] for r in frames.where_selection(df, t).select("event_id").collect()) for t in texts]
    assert len(kept[0]) == 503
    assert all(k == kept[0] for k in kept)


def test_regions_and_columns(spark):
    assert {regions.as_region(s) for s in ("2j2b", "r2j2b", "reg2j2b")} == {regions.Region.r2j2b}
    assert str(regions.Region.r1j1b) == "1j1b"
    with pytest.raises(ValueError):
        regions.as_region("4j4b")
    assert regions.avoids_for("2j2b") == ["deltaR_jet1_jet2"]
    with pytest.raises(ValueError):
        regions.avoids_for(regions.Region.rUnkn)
    assert regions.features_for("2j2b")[0] == "mass_lep1jet1"
    every = regions.features_for("ALL")
    assert every == sorted(set(every), key=str.lower) and len(every) == 19
    parts = regions.categorize_columns(
        ["pT_lep1", "pT_lep2", "weight_nominal", "weight_sys_jvt", "elmu", "OS", "reg1j1b", "reg2j2b", "other_weight"]
    )
    assert parts["kinematics"] == ["pT_lep1", "pT_lep2"]
    assert parts["weights"] == ["other_weight", "weight_nominal", "weight_sys_jvt"]
    assert parts["meta"] == ["elmu", "OS", "reg1j1b", "reg2j2b"]
    df = spark.createDataFrame([(1, 2.0, 3.0)], "b int, weight_nominal double, A double")
    assert regions.columns_from(df) == ["A", "b", "weight_nominal"]
    assert regions.columns_from(df, ignore_weights=True) == ["A", "b"]
    assert regions.default_parameters("2j1b")["max_depth"] == 7
    assert regions.train_axes(max_depth=3, unknown=1) == {**config.TRAIN_AXES, "max_depth": 3}


def test_every_feature_list_is_sorted():
    for table in (config.FEATURES, config.FEATURES_TMVA):
        for names in table.values():
            assert names == sorted(names, key=str.lower)


def test_config_is_read_at_call_time(monkeypatch):
    monkeypatch.setitem(config.SELECTIONS, "2j2b", "(reg2j2b == True) & (mass_lep1jet1 < 155)")
    monkeypatch.setitem(config.FEATURES, "2j2b", ["pT_jet1", "met"])
    assert selection_for("2j2b") == "(reg2j2b == True) & (mass_lep1jet1 < 155)"
    assert regions.features_for("2j2b") == ["met", "pT_jet1"]
