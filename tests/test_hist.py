import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.functions.binning import bin_centers, edges_and_centers
from evq.functions.stats import chi2_prob, kolmogorov_prob
from evq.operators import compare, features, frames, hist
from evq.plans.views import events


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 2000
    x = np.round(rng.normal(5, 3, n), 3)
    x[:6] = [0.0, 10.0, 2.5, 10.0001, -0.0001, 1e300]
    w = rng.normal(1, 0.8, n)
    label = (rng.random(n) < 0.3).astype(int)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(x, w, label)]
    rows += [(float("nan"), 1.0, 1), (None, 1.0, 0)]
    df = spark.createDataFrame(rows, "x double, weight_nominal double, label int").repartition(5)
    return df, x, w, label


def column(df, name, order="bin"):
    return np.array([r[name] for r in df.orderBy(order).collect()])


def test_edges_and_centers():
    edges, centers = edges_and_centers(10, (25, 225))
    assert edges == pytest.approx(np.linspace(25, 225, 11)) and edges[-1] == 225.0
    assert centers == pytest.approx([35, 55, 75, 95, 115, 135, 155, 175, 195, 215])
    assert bin_centers([0.0, 1.0, 3.0]) == [0.5, 2.0]
    with pytest.raises(ValueError):
        edges_and_centers(10)
    with pytest.raises(ValueError):
        edges_and_centers([0, 2, 1])


@pytest.mark.parametrize("bins, rng", [(8, (0.0, 10.0)), ([0.0, 0.5, 2.5, 2.75, 7.0, 10.0], None), ([0.0, 10.0], None)])
def test_histogram_equals_numpy(sample, bins, rng):
    df, x, w, _ = sample
    h = hist.weighted_histogram(df, "x", bins, rng)
    want, edges = np.histogram(x, bins, rng, weights=w)
    squares, _ = np.histogram(x, bins, rng, weights=w * w)
    assert column(h, "count") == pytest.approx(want)
    assert column(h, "err") == pytest.approx(np.sqrt(squares))
    assert column(h, "lo") == pytest.approx(edges[:-1]) and column(h, "hi") == pytest.approx(edges[1:])
    counted = hist.weighted_histogram(df, "x", bins, rng, weight=None)
    n, _ = np.histogram(x, bins, rng)
    assert column(counted, "count") == pytest.approx(n) and column(counted, "err") == pytest.approx(np.sqrt(n))


def test_flow_keeps_everything(sample):
    df, x, w, _ = sample
    h = hist.weighted_histogram(df, "x", 8, (0.0, 10.0), flow=True)
    want, _ = np.histogram(np.clip(x, 0, 10), 8, (0.0, 10.0), weights=w)
    assert column(h, "count") == pytest.approx(want)
    assert column(h, "count").sum() == pytest.approx(w.sum())


def test_empty_bins_and_empty_input(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (99.0, 1.0, "b")], "x double, weight_nominal double, k string")
    h = hist.weighted_histogram(df, "x", 3, (0.0, 3.0), by=["k"])
    got = {(r["k"], r["bin"]): r["count"] for r in h.collect()}
    assert got == {("a", 0): 0, ("a", 1): 2, ("a", 2): 0, ("b", 0): 0, ("b", 1): 0, ("b", 2): 0}
    none = hist.weighted_histogram(df.limit(0), "x", 3, (0.0, 3.0))
    assert column(none, "count").tolist() == [0, 0, 0]


def test_density_and_uniform(sample):
    df, x, w, _ = sample
    edges = [0.0, 0.5, 2.5, 2.75, 7.0, 10.0]
    h = hist.density_histogram(hist.weighted_histogram(df, "x", edges))
    want, _ = np.histogram(x, edges, weights=w, density=True)
    assert column(h, "count") == pytest.approx(want)
    u = hist.uniform_bins(h)
    assert column(u, "lo").tolist() == [0.5, 1.5, 2.5, 3.5, 4.5] and column(u, "hi")[-1] == 5.5


def test_many_variables_equal_single_ones(spark, sf):
    df = events(spark, sf)
    binnings = [("pT_lep1", 10, (0.0, 100.0)), ("mass_lep1jet1", [0.0, 50.0, 60.0, 300.0], None)]
    every = hist.histograms_by_variable(df, binnings, flow=True)
    for var, bins, rng in binnings:
        one = hist.weighted_histogram(df, var, bins, rng, flow=True)
        got = every.filter(F.col("var") == var)
        for name in ("count", "err", "lo", "hi"):
            assert column(got, name) == pytest.approx(column(one, name))


def test_skewed_key_is_pre_aggregated(spark, sf, capsys):
    hist.weighted_histogram(events(spark, sf), "pT_lep1", 10, (0.0, 100.0), by=["process"]).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.index("partial_sum") > 0 and "Join" not in plan and "Window" not in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_discount:double>" in plan


def test_templates_and_comparison(spark, sf):
    df = events(spark, sf)
    templates = hist.systematic_templates(df, "pT_lep1", 10, (0.0, 100.0))
    wide = compare.template_triplets(templates, "weight_sys_pileup_UP", "weight_sys_pileup_DOWN")
    full = compare.systematic_comparison(wide)
    for r in full.collect():
        if r["nominal"]:
            assert r["percent_up"] == pytest.approx((r["up"] - r["nominal"]) / r["nominal"] * 100)
    summary = compare.systematic_summary(full).first()
    assert summary["template_max"] == pytest.approx(max(max(r["up"], r["down"]) for r in wide.collect()))
    mirrored = compare.one_sided_systematic(wide.drop("down"))
    for r in mirrored.collect():
        if r["nominal"]:
            assert r["percent_down"] == pytest.approx(-r["percent_up"])


def test_stack_ratio(spark):
    df = spark.createDataFrame(
        [("Data", 1.0, 9.0)] * 4 + [("ttbar", 1.0, 0.5), ("Zjets", 1.0, 0.25), ("other", 1.0, 50.0), ("MCNP", 7.0, 1.0)],
        "process string, x double, weight_nominal double",
    )
    row = hist.data_mc_stack(df, "x", 2, (0.0, 4.0), lumi=2.0, combine_minor=True).orderBy("bin").first()
    assert (row["data"], row["data_err"], row["mc"]) == (4.0, 2.0, 1.5)
    assert row["mc_err"] == pytest.approx(math.sqrt(1 + 0.25))
    assert row["ratio"] == pytest.approx(4 / 1.5)
    assert row["ratio_err"] == pytest.approx(math.sqrt(4 / 1.5**2 + (4 * row["mc_err"] / 1.5**2) ** 2))
    assert (row["n_ttbar"], row["n_minor"], row["n_tW_DR"]) == (1.0, 0.5, 0.0)


def test_uncertainty_band(spark):
    df = spark.createDataFrame([(4.0, 1.0, 2.0), (0.1, 1.0, 1.0), (0.0, 1.0, 1.0)], "mc double, err_lo double, err_hi double")
    got = [tuple(r)[3:] for r in hist.uncertainty_band(df).collect()]
    assert got[0] == (3.0, 6.0, 0.75, 1.5) and got[1] == got[2] == (0.0, 0.0, 0.0, 0.0)


def test_signal_over_background(spark):
    df = spark.createDataFrame(
        [("tW_DR", 1, 2.0, 0.5), ("ttbar", 1, 4.0, 0.5), ("Zjets", 0, 8.0, 0.5), ("Data", 1, 100.0, 1.0)],
        "process string, OS int, weight_nominal double, weight_tptrw_tool double",
    )
    got = {r["selection"]: r["s_over_b"] for r in hist.signal_over_background(df, {"all": "OS >= 0", "os": "OS == 1"}).collect()}
    assert got == {"all": 2 / 6, "os": 1.0}
    plain = hist.signal_over_background(df, {"os": "OS == 1"}, use_tptrw=False).first()
    assert plain["s_over_b"] == 0.5


# --- tests of two histograms ----------------------------------------------------


def kolmogorov(z):
    u = abs(z)
    if u < 0.2:
        return 1.0
    if u < 0.755:
        return 1 - 2.50662827 * sum(math.exp(-(math.pi**2) / 8 * k * k / (u * u)) for k in (1, 3, 5)) / u
    if u >= 6.8116:
        return 0.0
    return 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * u * u) for j in range(1, max(1, round(3 / u)) + 1))


def test_kolmogorov_prob(spark):
    zs = [1.13, 0.0, 0.1, 0.2, 0.5, 0.754, 0.755, 0.86, 1.0, 1.2, 2.0, 3.0, 6.81, 6.9, 1e6, -1.13]
    df = spark.createDataFrame([(i, z) for i, z in enumerate(zs)] + [(99, None)], "i int, z double")
    got = [r["p"] for r in df.select("i", kolmogorov_prob(F.col("z")).alias("p")).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.15549781841748692, abs=1e-15)
    assert got[:-1] == pytest.approx([kolmogorov(z) for z in zs], abs=1e-9) and got[-1] is None


def test_chi2_prob(spark):
    # For 2 degrees of freedom exp(-x / 2); for 1, erfc(sqrt(x / 2)); for 4, exp(-x/2) (1 + x/2).
    cases = []
    for x in (0.0, 0.3, 1.0, 3.841, 9.21, 40.0):
        cases += [(x, 2, math.exp(-x / 2)), (x, 1, math.erfc(math.sqrt(x / 2))), (x, 4, math.exp(-x / 2) * (1 + x / 2))]
    df = spark.createDataFrame([(i, x, n) for i, (x, n, _) in enumerate(cases)] + [(999, 1.0, 0)], "i int, x double, n int")
    got = [r["p"] for r in df.select("i", chi2_prob(F.col("x"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert got[:-1] == pytest.approx([p for *_, p in cases], rel=1e-12) and got[-1] is None


def test_chi2_prob_of_large_and_odd_ndf(spark):
    def upper(x, n):
        """From erfc (odd) or exp (even) by the recurrence Q(a + 1, y) = Q(a, y) + y^a e^-y / gamma(a + 1)."""
        y, a, q = x / 2, (0.5 if n % 2 else 1.0), (math.erfc(math.sqrt(x / 2)) if n % 2 else math.exp(-x / 2))
        while a < n / 2:
            q += math.exp(a * math.log(y) - y - math.lgamma(a + 1))
            a += 1
        return q

    cases = [(x, n) for n in (3, 5, 7, 31, 101, 1001, 4000) for x in (0.2 * n, 0.9 * n, 1.1 * n, 1.5 * n)]
    df = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(cases)], "i int, x double, n int")
    got = [r["p"] for r in df.select("i", chi2_prob(F.col("x"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([upper(*c) for c in cases], rel=1e-9, abs=1e-12)


def pair(spark, h1, e1, h2, e2):
    return spark.createDataFrame(
        [(i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(h1, e1, h2, e2))],
        "bin int, h1 double, e1 double, h2 double, e2 double",
    ).repartition(3)


def test_two_sample_tests_equal_numpy(spark):
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 50, 12).astype(float), rng.integers(0, 80, 12).astype(float)
    h1[3] = 0
    e1, e2 = np.sqrt(h1) * 1.1, np.sqrt(h2) * 0.9
    pairs = pair(spark, h1, e1, h2, e2)
    n1, n2 = h1.sum() ** 2 / (e1**2).sum(), h2.sum() ** 2 / (e2**2).sum()
    root = math.sqrt(n1 * n2 / (n1 + n2))
    difference = h1 / h1.sum() - h2 / h2.sum()
    got = compare.ks_two_sample(pairs).first()
    assert got["ks_stat"] == pytest.approx(np.abs(difference).max())
    assert got["ks_z"] == pytest.approx(np.abs(difference).max() * root)
    assert got["ks_pvalue"] == pytest.approx(kolmogorov(got["ks_z"]), abs=1e-9)
    running = compare.ks_two_sample(pairs, cumulative=True).first()
    assert running["ks_stat"] == pytest.approx(np.abs(np.cumsum(difference)).max())
    good = (h1 != 0) & (h2 != 0)
    a, b, ea, eb = h1[good], h2[good], e1[good], e2[good]
    for symmetric in (False, True):
        second = a.sum() ** 2 if symmetric else a.sum() * b.sum()
        sigma = second * eb**2 + b.sum() ** 2 * ea**2
        want = ((b.sum() * a - a.sum() * b) ** 2 / sigma).sum()
        test = compare.chi2_two_sample(pairs, symmetric=symmetric).first()
        assert test["chi2"] == pytest.approx(want) and test["ndf"] == good.sum() - 1
        assert 0 <= test["chi2_pvalue"] <= 1


def test_identical_histograms(spark):
    h = [5, 0, 7, 1]
    pairs = pair(spark, h, np.sqrt(h), h, np.sqrt(h))
    ks = compare.ks_two_sample(pairs).first()
    assert (ks["ks_stat"], ks["ks_pvalue"]) == (0.0, 1.0)
    chi2 = compare.chi2_two_sample(pairs).first()
    assert (chi2["chi2"], chi2["ndf"], chi2["chi2_pvalue"]) == (0.0, 2, 1.0)
    empty = compare.ks_two_sample(pair(spark, [0, 0], [0, 0], [1, 2], [1, 1])).first()
    assert empty["ks_stat"] is None and empty["ks_pvalue"] is None


def test_pairing_two_tables(spark):
    first = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 0.5)], "bin int, count double, err double")
    second = spark.createDataFrame([(1, 3.0, 0.25), (2, 4.0, 0.25)], "bin int, count double, err double")
    got = sorted(tuple(r) for r in compare.pair_histograms(first, second).collect())
    assert got == [(0, 1.0, 0.5, 0.0, 0.0), (1, 2.0, 0.5, 3.0, 0.25), (2, 0.0, 0.0, 4.0, 0.25)]


# --- feature statistics ---------------------------------------------------------


def test_constant_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, nan, nan), (1.0, 3.0, 4.0, nan), (1.0, 2.0, nan, nan)], "a double, b double, c double, d double")
    got = {r["column"]: r["value"] for r in features.constant_columns(df).collect()}
    assert got == {"a": 1.0, "c": 4.0}
    assert features.drop_constant_columns(df).columns == ["b", "d"]


def test_correlations_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1000.0, 1.0, (400, 4))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, 400)
    x[rng.random((400, 4)) < 0.1] = np.nan
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(6)
    import pandas as pd

    want = pd.DataFrame(x, columns=names).corr()
    rows = features.correlation_matrix(df, names).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["coeff"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-8)
    found = features.correlated_pairs(features.correlation_matrix(df, names)).collect()
    assert [(r["drop_this"], r["because"]) for r in found] == [("b", "a")]


@pytest.mark.parametrize("more", [0, 10])
def test_correlations_with_constants_are_null(spark, more):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("a"), F.lit(0.1).alias("b"), (1e9 + F.col("id") * 1e-3).alias("c"), F.lit(None).cast("double").alias("d"),
        *[(F.col("id") % (i + 2)).cast("double").alias(f"e{i}") for i in range(more)],
    ).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["coeff"] for r in features.correlation_matrix(df).collect()}
    assert len(got) == (4 + more) * (3 + more) // 2
    assert got["a", "b"] is None and got["b", "c"] is None and got["a", "d"] is None
    assert got["a", "c"] == pytest.approx(1.0, abs=1e-6)


def test_many_features_use_one_pass(spark, capsys):
    names = [f"f{i}" for i in range(30)]
    df = spark.range(100).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(n) for i, n in enumerate(names)])
    matrix = features.correlation_matrix(df, names)
    matrix.explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Join" not in plan and plan.count("Range (") == 2  # tree and details name the one scan
    assert matrix.count() == 30 * 29 // 2


def test_correlations_of_nothing(spark):
    rows = features.correlation_matrix(spark.createDataFrame([], "a double, b int")).collect()
    assert [tuple(r) for r in rows] == [(0, "a", 1, "b", None)]
    assert features.correlation_matrix(spark.createDataFrame([(1.0,)], "a double")).count() == 0


def test_correlation_shuffle_does_not_grow_with_tasks(spark):
    df = spark.range(0, 20000, numPartitions=400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    matrix = features.correlation_matrix(df)
    assert df.rdd.getNumPartitions() == 400 and matrix.rdd.getNumPartitions() == 1
    want = np.corrcoef(np.arange(20000), np.arange(20000) % 7)[0, 1]
    assert matrix.first()["coeff"] == pytest.approx(want, abs=1e-12)


def test_feature_candidates(spark):
    importances = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 6.0), ("e", 5.0)], "feature string, importance double")
    pairs = spark.createDataFrame([("c", "d", 0.9), ("b", "a", 0.95), ("e", "q", 0.9)], "drop_this string, because string, coeff double")
    # c beats d, which leaves; b loses to a; e's partner has no importance, so e does not win against it
    got = [r["feature"] for r in features.feature_candidates(importances, pairs, 5).collect()]
    assert got == ["a", "c"]
    assert [r["feature"] for r in features.feature_candidates(importances, pairs, 1).collect()] == ["a"]


def test_two_sample_templates_excluded(spark, sf):
    df = events(spark, sf)
    rows = hist.two_sample_templates(df, "score").collect()
    assert len(rows) == 54
    for r in rows:
        center = (r["lo"] + r["hi"]) / 2
        low, high = {"1j1b": (0.35, 9), "2j1b": (-9, 0.7), "2j2b": (0.45, 0.775)}[r["region"]]
        assert r["excluded"] == (center < low or center > high)
    region = frames.select_region(df.filter("sample_group = 'tW_DS'"), "2j1b")
    one = hist.weighted_histogram(frames.scale_by_lumi(region), "score", 18, (0.2, 0.85), flow=True)
    got = sorted((r["bin"], r["count2"]) for r in rows if r["region"] == "2j1b")
    assert [c for _, c in got] == pytest.approx(column(one, "count"))
