"""Queries over ROC curves, AUC, response shapes and scan results."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.operators import frames, ml, ranking
from evq.plans.catalog import query, rounded, unit_sql
from evq.plans.views import EVENT_SQL, SCAN_SQL, events, scan_results
from evq.operators.sampling import kfold_assign, train_test_split

KEY = "event_id"

# label, weight, exact score, process as a key, fold and split from the hash of the row key
SCORED_SQL = f"""WITH raw AS ({EVENT_SQL}), ev AS (SELECT process, label, score AS s,
    CASE WHEN weight_nominal < 0 THEN 0 ELSE weight_nominal END AS w,
    CAST({unit_sql()} % 3 AS INT) AS fold,
    CASE WHEN {unit_sql()} < {int(round(0.4 * 2**32))} THEN 'test' ELSE 'train' END AS split FROM raw)"""


def _scored(spark, sf):
    df = events(spark, sf).withColumn("weight", frames.clipped("weight_nominal"))
    return df.select(KEY, "process", "label", "weight", "score")


def _points_sql(by: str) -> str:
    return f"""p AS (SELECT {by}, s, sum(w) FILTER (label = 1) AS ws, sum(w) FILTER (label = 0) AS wb FROM ev GROUP BY {by}, s),
    c AS (SELECT {by}, s, coalesce(ws, 0) AS ws, coalesce(wb, 0) AS wb,
      sum(coalesce(ws, 0)) OVER (PARTITION BY {by} ORDER BY s DESC) AS cs, sum(coalesce(wb, 0)) OVER (PARTITION BY {by} ORDER BY s DESC) AS cb,
      sum(coalesce(ws, 0)) OVER (PARTITION BY {by}) AS ts, sum(coalesce(wb, 0)) OVER (PARTITION BY {by}) AS tb FROM p)"""


def _auc_sql(by: str) -> str:
    """Trapezoid over the curve points."""
    return f"""{_points_sql(by)}, a AS (SELECT {by}, sum(wb * (cs - ws / 2)) / nullif(max(ts) * max(tb), 0) AS auc FROM c GROUP BY {by})"""


@query("weighted_auc", f"{SCORED_SQL}, {_auc_sql('process')} SELECT process, round(auc, 9) AS auc FROM a")
def _(spark, sf):
    return rounded(ranking.weighted_auc(_scored(spark, sf), by=["process"]), 9, "auc")


@query(
    "weighted_auc_all",
    f"{SCORED_SQL}, one AS (SELECT 1 AS k, * FROM ev), {_auc_sql('k').replace('FROM ev', 'FROM one')} SELECT round(auc, 9) AS auc FROM a",
)
def _(spark, sf):
    return rounded(ranking.weighted_auc(_scored(spark, sf)), 9, "auc")


def _scaled_sql(factor: str) -> str:
    return f"""{SCORED_SQL}, {_auc_sql('process').replace('FROM ev', f'FROM (SELECT * REPLACE (s * CAST({factor} AS DOUBLE) AS s) FROM ev)')} SELECT process, round(auc, 9) AS auc FROM a"""


@query("weighted_auc_tiny_scores", _scaled_sql("1e-12"))
def _(spark, sf):
    df = _scored(spark, sf).withColumn("score", F.col("score") * 1e-12)
    return rounded(ranking.weighted_auc(df, by=["process"]), 9, "auc")


@query("weighted_auc_huge_scores", _scaled_sql("1e11"))
def _(spark, sf):
    df = _scored(spark, sf).withColumn("score", F.col("score") * 1e11)
    return rounded(ranking.weighted_auc(df, by=["process"]), 9, "auc")


@query(
    "roc_curve",
    f"""{SCORED_SQL}, {_points_sql('process')} SELECT process, round(s, 9) AS threshold, round(cb / nullif(tb, 0), 9) AS fpr,
      round(cs / nullif(ts, 0), 9) AS tpr FROM c""",
)
def _(spark, sf):
    return rounded(ranking.roc_curve(_scored(spark, sf), by=["process"]), 9, "threshold", "fpr", "tpr")


_MEAN_SQL = f"""{SCORED_SQL}, {_points_sql('fold')},
    r AS (SELECT fold, least(round(cb / tb, 12), 1.0) AS f, least(round(cs / ts, 12), 1.0) AS t FROM c),
    n AS (SELECT fold, g.range AS i, g.range / 99.0::DOUBLE AS x,
      max({{'f': f, 't': t}}) FILTER (ceil(f * 99) <= g.range) AS l, min({{'f': f, 't': t}}) FILTER (ceil(f * 99) > g.range) AS r
      FROM r, range(100) g GROUP BY fold, g.range),
    e AS (SELECT i, x, CASE WHEN i = 0 THEN 0 ELSE coalesce(l.t, 0) + coalesce((r.t - coalesce(l.t, 0)) / nullif(r.f - coalesce(l.f, 0), 0)
      * (x - coalesce(l.f, 0)), 0) END AS t FROM n),
    curve AS (SELECT CAST(i AS INT) AS point, x AS fpr, CASE WHEN i = 99 THEN 1 ELSE avg(t) END AS tpr FROM e GROUP BY i, x)"""


@query("mean_roc", f"{_MEAN_SQL} SELECT point, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve")
def _(spark, sf):
    return rounded(ranking.mean_roc(kfold_assign(_scored(spark, sf), KEY)), 9, "fpr", "tpr")


@query(
    "fold_summary",
    f"""{_MEAN_SQL}, a AS (SELECT fold, sum(wb * (cs - ws / 2)) / (max(ts) * max(tb)) AS auc FROM c GROUP BY fold),
    m AS (SELECT sum(CASE WHEN point IN (0, 99) THEN tpr / 2 ELSE tpr END) / 99 AS auc FROM curve)
    SELECT round(any_value(m.auc), 9) AS auc, round(stddev_pop(a.auc), 9) AS auc_std, round(-avg(a.auc), 9) AS score, CAST(count(*) AS INT) AS folds
    FROM a, m""",
)
def _(spark, sf):
    return rounded(ranking.fold_summary(kfold_assign(_scored(spark, sf), KEY)), 9, "auc", "auc_std", "score")


_RESPONSE_SQL = f"""{SCORED_SQL},
    lim AS (SELECT min(s) FILTER (label = 0) AS lo, max(s) FILTER (label = 1) AS hi FROM ev),
    b AS (SELECT split, label, CASE WHEN s >= lo AND s <= hi THEN least(CAST(floor((s - lo) / ((hi - lo) / 30)) AS INT), 29) END AS bin, w FROM ev, lim),
    h AS (SELECT split, label, bin, sum(w) AS count, sqrt(sum(w * w)) AS err FROM b GROUP BY ALL),
    d AS (SELECT k.split, k.label, CAST(g.range AS INT) AS bin, lo + g.range * ((hi - lo) / 30) AS lo,
      CASE WHEN g.range = 29 THEN hi ELSE lo + (g.range + 1) * ((hi - lo) / 30) END AS hi,
      coalesce(h.count, 0) AS c, coalesce(h.err, 0) AS e
      FROM (SELECT DISTINCT split, label FROM ev) k CROSS JOIN range(30) g CROSS JOIN lim
      LEFT JOIN h ON h.split = k.split AND h.label = k.label AND h.bin = g.range),
    n AS (SELECT *, c / sum(c * (hi - lo)) OVER (PARTITION BY split, label) AS dens,
      e / sum(c * (hi - lo)) OVER (PARTITION BY split, label) AS derr FROM d)"""


def _split(spark, sf):
    return train_test_split(_scored(spark, sf), KEY, 0.4)


@query(
    "response_histograms",
    f"""{_RESPONSE_SQL} SELECT split, label, bin, round(lo, 9) AS lo, round(hi, 9) AS hi, round(dens, 9) AS count,
      round(derr, 9) AS err FROM n""",
)
def _(spark, sf):
    return rounded(ranking.response_histograms(_split(spark, sf)), 9, "lo", "hi", "count", "err")


_KS_SQL = f"""{_RESPONSE_SQL}, pr AS (SELECT label, bin, max(dens) FILTER (split = 'train') AS h1, max(derr) FILTER (split = 'train') AS e1,
      max(dens) FILTER (split = 'test') AS h2, max(derr) FILTER (split = 'test') AS e2 FROM n GROUP BY label, bin),
    sm AS (SELECT label, sum(h1) AS s1, sum(h2) AS s2, sum(h1) * sum(h1) / sum(e1 * e1) AS n1, sum(h2) * sum(h2) / sum(e2 * e2) AS n2
      FROM pr GROUP BY label),
    ks AS (SELECT label, max(abs(h1 / s1 - h2 / s2)) AS stat, max(sqrt(n1 * n2 / (n1 + n2))) * max(abs(h1 / s1 - h2 / s2)) AS u
      FROM pr JOIN sm USING (label) GROUP BY label),
    pv AS (SELECT label, stat, CASE WHEN u < 0.2 THEN 1
      WHEN u < 0.755 THEN 1 - 2.50662827 * (exp(-1.2337005501361697 / (u * u)) + exp(-11.103304951225528 / (u * u)) + exp(-30.842513753404244 / (u * u))) / u
      WHEN u < 6.8116 THEN 2 * (exp(-2 * u * u) - CASE WHEN round_even(3.0 / u, 0) >= 2 THEN exp(-8 * u * u) ELSE 0 END
        + CASE WHEN round_even(3.0 / u, 0) >= 3 THEN exp(-18 * u * u) ELSE 0 END - CASE WHEN round_even(3.0 / u, 0) >= 4 THEN exp(-32 * u * u) ELSE 0 END)
      ELSE 0 END AS p FROM ks),
    q AS (SELECT round(max(stat) FILTER (label = 1), 5) AS ks_test_sig, round(max(p) FILTER (label = 1), 5) AS ks_pvalue_sig,
      round(max(stat) FILTER (label = 0), 5) AS ks_test_bkg, round(max(p) FILTER (label = 0), 5) AS ks_pvalue_bkg FROM pv)"""


@query("response_ks", f"{_KS_SQL} SELECT * FROM q")
def _(spark, sf):
    return ranking.response_ks(ranking.response_histograms(_split(spark, sf)))


@query("training_quality", f"{_KS_SQL} SELECT *, ks_pvalue_sig < 0.2 OR ks_pvalue_bkg < 0.2 AS bad_ks FROM q")
def _(spark, sf):
    return ranking.training_quality(ranking.response_ks(ranking.response_histograms(_split(spark, sf))))


# --- scan results ---------------------------------------------------------------


@query(
    "select_best_scan",
    f"""WITH s AS ({SCAN_SQL}), g AS (SELECT * FROM s WHERE NOT bad_ks)
    SELECT * FROM g WHERE round_even(auc, 2) = (SELECT round_even(max(auc), 2) FROM g) AND ks_pvalue_bkg > 0.95
    ORDER BY ks_pvalue_sig DESC, name LIMIT 16""",
)
def _(spark, sf):
    return ml.select_best_scan(scan_results(spark, sf))


@query(
    "penalized_score",
    f"""WITH s AS ({SCAN_SQL}) SELECT *, round(CASE WHEN ks_pvalue_sig < 0.1 OR ks_pvalue_bkg < 0.1 THEN auc * 0.9 ELSE auc END, 9)
    AS penalized FROM s""",
)
def _(spark, sf):
    return rounded(ml.penalized_score(scan_results(spark, sf)), 9, "penalized")


@query(
    "best_penalized",
    f"""WITH s AS ({SCAN_SQL}), p AS (SELECT *, CASE WHEN ks_pvalue_sig < 0.1 OR ks_pvalue_bkg < 0.1 THEN auc * 0.9 ELSE auc END AS v FROM s)
    SELECT * EXCLUDE (v), round(v, 9) AS penalized FROM p ORDER BY v DESC, name LIMIT 1""",
)
def _(spark, sf):
    return rounded(ml.best_penalized(scan_results(spark, sf)), 9, "penalized")


@query(
    "combine_scores",
    f"""WITH ev AS ({EVENT_SQL}) SELECT event_id, CASE WHEN reg2j2b AND OS = 1 AND mass_lep1jet1 < 155 THEN 1.0 - score
      WHEN OS = 1 THEN score ELSE -9999.0 END AS response FROM ev""",
)
def _(spark, sf):
    df = events(spark, sf).withColumn("other", 1.0 - F.col("score"))
    scores = [("OS == 1", "score"), ("(reg2j2b == True) & (OS == True) & (mass_lep1jet1 < 155)", "other")]
    return ml.combine_scores(df, scores).select(KEY, "response")
