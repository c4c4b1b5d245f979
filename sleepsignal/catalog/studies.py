"""Statistics, model comparison and machine learning on the cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.cohorts import LONG, long
from sleepsignal.catalog.fixtures import FEATURES, table, with_views
from sleepsignal.catalog.registry import query
from sleepsignal.operators import compare, ml, report, stats
from sleepsignal.plans import training
from sleepsignal.session import cut

# ---- univariate statistics ----

LAB = f"""{LONG}, lab AS (
SELECT 'control_vs_irbd' AS split, CASE segment_group WHEN 'iRBD' THEN 1 WHEN 'Control' THEN 0 END AS y, * FROM long UNION ALL
SELECT 'control_vs_pdrbd', CASE segment_group WHEN 'PD(+RBD)' THEN 1 WHEN 'Control' THEN 0 END, * FROM long UNION ALL
SELECT 'control_vs_all', CASE segment_group WHEN 'PD(+RBD)' THEN 1 WHEN 'iRBD' THEN 1 WHEN 'Control' THEN 0 END, * FROM long),
l AS (SELECT * FROM lab WHERE y IS NOT NULL)"""

STAT = f"""{LAB},
mo AS (SELECT split, feature, count(value) FILTER (WHERE y = 1) AS n1, count(value) FILTER (WHERE y = 0) AS n0, avg(value) FILTER (WHERE y = 1) AS m1,
  avg(value) FILTER (WHERE y = 0) AS m0, var_samp(value) FILTER (WHERE y = 1) AS v1, var_samp(value) FILTER (WHERE y = 0) AS v0 FROM l GROUP BY 1, 2),
rk AS (SELECT split, feature, y, value, rank() OVER (PARTITION BY split, feature ORDER BY value) + (count(*) OVER (PARTITION BY split, feature, value) - 1) / 2 AS r FROM l WHERE value IS NOT NULL),
us AS (SELECT split, feature, sum(r) FILTER (WHERE y = 1) AS rs FROM rk GROUP BY 1, 2),
ti AS (SELECT split, feature, sum(t * t * t - t) AS ties FROM (SELECT split, feature, value, CAST(count(*) AS DOUBLE) AS t FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2),
mw AS (SELECT split, feature, n1, n0, m1, m0, v1, v0, rs - n1 * (n1 + 1) / 2 AS u, ties FROM mo JOIN us USING (split, feature) JOIN ti USING (split, feature)),
st AS (SELECT *, (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) AS d, u / n1 / n0 AS a, 2 * u / n1 / n0 - 1 AS delta,
  (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * CAST(n1 + n0 - 1 AS DOUBLE)))) AS z,
  (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM mw)"""

# Two-sided normal and Student p-values by Simpson's rule on smooth integrands.
SIMPSON = "si AS (SELECT unnest(range(0, 2001)) AS i)"
PN = f"""pn AS (SELECT split, feature, CASE WHEN z < 0 THEN 1 ELSE 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-pow(z * i / 2000, 2) / 2)) * abs(z) / 6000 / sqrt(2 * pi()) END AS p_u FROM st, si GROUP BY split, feature, z)"""
PT = f"""pt AS (SELECT split, feature, 1 - sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1))
  * atan(abs(t) / sqrt(df)) / 6000 * 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - lgamma(0.5)) AS p_t FROM st, si GROUP BY split, feature, t, df)"""


def labelled(spark, sf):
    return stats.binary_split(long(spark, sf), group="segment_group")


def full_stats(spark, sf):
    lab = labelled(spark, sf)
    m = stats.welch_t(stats.moments(lab))
    return m.join(stats.mann_whitney(lab).drop("n_pos", "n_neg"), ["split", "feature"])


@query("binary_split", with_views("features", body=f", {LAB} SELECT split, y, subject_id, segment_group, feature, value FROM l"))
def binary_split(spark, sf):
    return labelled(spark, sf)


@query("cohens_d", with_views("features", body=f", {STAT} SELECT split, feature, n1 AS n_pos, n0 AS n_neg, round(d, 6) AS cohens_d FROM st"))
def cohens_d(spark, sf):
    return stats.moments(labelled(spark, sf)).select("split", "feature", "n_pos", "n_neg", F.round(stats.cohens_d(), 6).alias("cohens_d"))


@query("cliffs_delta", with_views("features", body=f", {STAT} SELECT split, feature, u, round(delta, 6) AS cliffs_delta FROM st"))
def cliffs_delta(spark, sf):
    return stats.mann_whitney(labelled(spark, sf)).select("split", "feature", "u", F.round(stats.cliffs_delta(), 6).alias("cliffs_delta"))


@query("feature_auc", with_views("features", body=f", {STAT} SELECT split, feature, round(greatest(a, 1 - a), 6) AS auc FROM st"))
def feature_auc(spark, sf):
    return stats.mann_whitney(labelled(spark, sf)).select("split", "feature", F.round(stats.feature_auc(), 6).alias("auc"))


_D = "CASE WHEN d IS NULL THEN 'n/a' WHEN abs(d) < 0.02 THEN 'negligible' WHEN abs(d) < 0.05 THEN 'small' WHEN abs(d) < 0.08 THEN 'medium' ELSE 'large' END"
_C = "CASE WHEN delta IS NULL THEN 'n/a' WHEN abs(delta) * 10 < 0.147 THEN 'negligible' WHEN abs(delta) * 10 < 0.33 THEN 'small' WHEN abs(delta) * 10 < 0.474 THEN 'medium' ELSE 'large' END"


@query("effect_labels", with_views("features", body=f", {STAT} SELECT split, feature, {_D} AS d_label, {_C} AS delta_label FROM st"))
def effect_labels(spark, sf):
    s = full_stats(spark, sf)
    return s.select("split", "feature", stats.interpret_d(stats.cohens_d() * 10).alias("d_label"), stats.interpret_cliffs(stats.cliffs_delta() * 10).alias("delta_label"))


@query("welch_t", with_views("features", body=f", {STAT}, {SIMPSON}, {PT} SELECT split, feature, round(t, 6) AS t, round(df, 4) AS df, round(p_t, 6) AS p FROM st JOIN pt USING (split, feature)"))
def welch_t(spark, sf):
    s = stats.welch_t(stats.moments(labelled(spark, sf)))
    return s.select("split", "feature", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("p_t", 6).alias("p"))


@query("mann_whitney", with_views("features", body=f", {STAT}, {SIMPSON}, {PN} SELECT split, feature, u, round(z, 6) AS z, round(p_u, 6) AS p FROM st JOIN pn USING (split, feature)"))
def mann_whitney(spark, sf):
    return stats.mann_whitney(labelled(spark, sf)).select("split", "feature", "u", F.round("z_u", 6).alias("z"), F.round("p_u", 6).alias("p"))


FDR = f"""{STAT}, {SIMPSON}, {PN}, bh0 AS (SELECT split, feature, p_u AS p, p_u * count(*) OVER (PARTITION BY split) / row_number() OVER (PARTITION BY split ORDER BY p_u, feature) AS q,
  row_number() OVER (PARTITION BY split ORDER BY p_u, feature) AS i FROM pn),
bh AS (SELECT split, feature, p, least(1, min(q) OVER (PARTITION BY split ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh_fdr FROM bh0)"""


@query("bh_fdr", with_views("features", body=f", {FDR} SELECT split, feature, round(p, 6) AS p, round(p_bh_fdr, 6) AS p_bh_fdr FROM bh"))
def bh_fdr(spark, sf):
    p = stats.mann_whitney(labelled(spark, sf)).select("split", "feature", F.col("p_u").alias("p"))
    return stats.bh_fdr(p).select("split", "feature", F.round("p", 6).alias("p"), F.round("p_bh_fdr", 6).alias("p_bh_fdr"))


@query("univariate_table_u", with_views("features", body=f""", {FDR}
SELECT split, feature, 'mann_whitney_u' AS test, u AS stat, round(p, 6) AS p, round(d, 6) AS cohens_d, round(delta, 6) AS cliffs_delta, round(greatest(a, 1 - a), 6) AS auc,
  n1 AS n_pos, n0 AS n_neg, round(p_bh_fdr, 6) AS p_bh_fdr, p_bh_fdr < 0.05 AS significant FROM st JOIN bh USING (split, feature)"""))
def univariate_table_u(spark, sf):
    t = stats.univariate_table(labelled(spark, sf), "u")
    r = [F.round(c, 6).alias(c) for c in ("p", "cohens_d", "cliffs_delta", "auc", "p_bh_fdr")]
    return t.select("split", "feature", "test", "stat", *r, "n_pos", "n_neg", F.col("`significant_fdr_0.05`").alias("significant"))


# Normal quantile x of p by rational approximation (fixed values), good to nine digits.
PPF = """lo AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS q FROM ps),
ac AS (SELECT *, CASE WHEN least(p, 1 - p) < 0.02425 THEN
   -(((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838e+00) * q - 2.549732539343734e+00) * q + 4.374664141464968e+00) * q + 2.938163982698783e+00)
   / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996e+00) * q + 3.754408661907416e+00) * q + 1)
  ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r - 2.759285104469687e+02) * r + 1.383577518672690e+02) * r - 3.066479806614716e+01) * r + 2.506628277459239e+00) * abs(p - 0.5)
   / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r - 1.556989798598866e+02) * r + 6.680131188771972e+01) * r - 1.328068155288572e+01) * r + 1) END * sign(p - 0.5) AS x
  FROM (SELECT *, pow(p - 0.5, 2) AS r FROM lo))"""

# W and p after Royston (1995), coefficients fixed, from the ordered values of each class.
NORMALITY = f"""n AS (SELECT split, feature, y, count(value) AS n FROM l GROUP BY 1, 2, 3),
ps AS (SELECT split, feature, y, value, n, i, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM (
  SELECT l.*, n, row_number() OVER (PARTITION BY split, feature, y ORDER BY value, subject_id) AS i FROM l JOIN n USING (split, feature, y) WHERE value IS NOT NULL)),
{PPF},
sw AS (SELECT split, feature, y, n, 1 / sqrt(n) AS r, ln(n) AS g, sum(x * x) AS q, max(x) FILTER (WHERE i = n) AS ml, max(x) FILTER (WHERE i = n - 1) AS ms,
  max(value) FILTER (WHERE i = 1) AS x1, max(value) FILTER (WHERE i = 2) AS x2, max(value) FILTER (WHERE i = n - 1) AS x3, max(value) FILTER (WHERE i = n) AS x4,
  coalesce(sum(x * value) FILTER (WHERE i BETWEEN 3 AND n - 2), 0) AS mid, var_pop(value) * n AS ss FROM ac GROUP BY 1, 2, 3, 4),
wa AS (SELECT *, ((((-2.706056e0 * r + 4.434685e0) * r - 2.071190e0) * r - 0.147981e0) * r + 0.221157e0) * r + ml / sqrt(q) AS a1,
  ((((-3.582633e0 * r + 5.682633e0) * r - 1.752461e0) * r - 0.293762e0) * r + 0.042981e0) * r + ms / sqrt(q) AS a2 FROM sw),
ww AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN x4 - x1 < 1e-19 THEN 1 WHEN n = 3 THEN least(1, pow(sqrt(0.5e0) * (x4 - x1), 2) / ss)
  WHEN n <= 5 THEN least(1, pow(a1 * (x4 - x1) + (ms * (x3 - x2) + mid) / sqrt((q - 2 * ml * ml) / (1 - 2 * a1 * a1)), 2) / ss)
  ELSE least(1, pow(a1 * (x4 - x1) + a2 * (x3 - x2) + mid / sqrt((q - 2 * ml * ml - 2 * ms * ms) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss) END AS w FROM wa),
wz AS (SELECT *, CASE WHEN n <= 3 OR w >= 1 THEN NULL
  WHEN n > 11 THEN (ln(1 - w) - (((0.0038915e0 * g - 0.083751e0) * g - 0.31082e0) * g - 1.5861e0)) / exp((0.0030302e0 * g - 0.082676e0) * g - 0.4803e0)
  WHEN ln(1 - w) >= -2.273e0 + 0.459e0 * n THEN 38
  ELSE (-ln(-2.273e0 + 0.459e0 * n - ln(1 - w)) - (((-0.0006714e0 * n + 0.025054e0) * n - 0.39978e0) * n + 0.5440e0))
    / exp(((-0.0020322e0 * n + 0.062767e0) * n - 0.77857e0) * n + 1.3822e0) END AS z FROM ww),
wi AS (SELECT split, feature, y, 0.5 - z / 6000 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000, 2) / 2)) AS tail
  FROM wz, si GROUP BY split, feature, y, z),
sh AS (SELECT n.split, n.feature, n.y, n.n, w, CASE WHEN x4 - x1 < 1e-19 OR w >= 1 THEN 1 WHEN n.n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75e0)))) ELSE greatest(0, tail) END AS p
  FROM n LEFT JOIN wz USING (split, feature, y) LEFT JOIN wi USING (split, feature, y)),
ch AS (SELECT split, feature, CASE WHEN bool_and(coalesce(p >= 0.05, FALSE)) AND count(*) = 2 THEN 't' ELSE 'u' END AS chosen FROM sh GROUP BY 1, 2)"""


_TABLE = """tt AS (SELECT st.*, chosen, n1 >= 2 AND n0 >= 2 AS ok, CASE WHEN chosen = 't' THEN p_t ELSE p_u END AS p FROM st JOIN ch USING (split, feature) LEFT JOIN pt USING (split, feature) LEFT JOIN pn USING (split, feature)),
t0 AS (SELECT *, p * count(p) OVER (PARTITION BY split) / row_number() OVER w AS bq, row_number() OVER w AS bi FROM tt WHERE ok WINDOW w AS (PARTITION BY split ORDER BY p, feature)),
t1 AS (SELECT *, least(1, min(bq) OVER (PARTITION BY split ORDER BY bi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh_fdr FROM t0)"""


@query("univariate_table", with_views("features", body=f""", {STAT}, {SIMPSON}, {PN}, {PT}, {NORMALITY}, {_TABLE}
SELECT split, feature, CASE WHEN chosen = 't' THEN 'welch_t' ELSE 'mann_whitney_u' END AS test, round(CASE WHEN chosen = 't' THEN t ELSE u END, 6) AS stat, round(p, 6) AS p, round(d, 6) AS cohens_d, round(abs(d), 6) AS abs_cohens_d,
  {_D.replace("0.02", "0.2").replace("0.05", "0.5").replace("0.08", "0.8")} AS cohens_d_interpretation, round(delta, 6) AS cliffs_delta, round(abs(delta), 6) AS abs_cliffs_delta,
  {_C.replace(" * 10", "")} AS cliffs_interpretation, round(greatest(a, 1 - a), 6) AS auc, n1 AS n_pos, n0 AS n_neg, round(p_bh_fdr, 6) AS p_bh_fdr, p_bh_fdr < 0.05 AS "significant_fdr_0.05" FROM t1"""))
def univariate_table(spark, sf):
    t = stats.univariate_table(labelled(spark, sf), "auto")
    return t.withColumns({c: F.round(c, 6) for c in ("stat", "p", "cohens_d", "abs_cohens_d", "cliffs_delta", "abs_cliffs_delta", "auc", "p_bh_fdr")})


@query("shapiro_summary", with_views("features", body=f""", {LAB}, {SIMPSON}, {NORMALITY}
SELECT split, feature, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS class, n, round(w, 6) AS "W", round(p, 6) AS p, p >= 0.05 AS "normal_at_0.05" FROM sh"""))
def shapiro_summary(spark, sf):
    return stats.shapiro_summary(labelled(spark, sf)).withColumns({c: F.round(c, 6) for c in ("W", "p")})


@query("normality_overview", with_views("features", body=f""", {LAB}, {SIMPSON}, {NORMALITY}
SELECT *, coalesce(positive AND negative, FALSE) AS both_normal FROM (
  SELECT split, feature, bool_or(p >= 0.05) FILTER (WHERE y = 1) AS positive, bool_or(p >= 0.05) FILTER (WHERE y = 0) AS negative FROM sh GROUP BY 1, 2)"""))
def normality_overview(spark, sf):
    return stats.normality_overview(stats.shapiro_summary(labelled(spark, sf)))


@query("choose_test", with_views("features", body=f", {LAB}, {SIMPSON}, {NORMALITY} SELECT split, feature, chosen FROM ch"))
def choose_test(spark, sf):
    return stats.choose_test(stats.shapiro_summary(labelled(spark, sf)))


POSITIONS = f"""{LAB}, n AS (SELECT split, feature, y, count(value) AS n FROM l GROUP BY 1, 2, 3),
o AS (SELECT split, feature, y, value, n, row_number() OVER (PARTITION BY split, feature, y ORDER BY value, subject_id) AS i FROM l JOIN n USING (split, feature, y) WHERE value IS NOT NULL),
ps AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1 / n) WHEN i = 1 THEN 1 - pow(0.5, 1 / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o),
{PPF}"""


@query("qq_points", with_views("features", body=f", {POSITIONS} SELECT split, feature, CAST(y AS INTEGER) AS y, i - 1 AS i, round(p, 9) AS position, round(x, 3) AS theoretical, value AS ordered FROM ac"))
def qq_points(spark, sf):
    return stats.qq_points(labelled(spark, sf)).withColumns({"position": F.round("position", 9), "theoretical": F.round("theoretical", 3)})


@query("qq_line", with_views("features", body=f""", {POSITIONS}
SELECT split, feature, CAST(y AS INTEGER) AS y, round(regr_slope(value, x), 3) AS slope, round(regr_intercept(value, x), 3) AS intercept, round(corr(value, x), 6) AS r FROM ac GROUP BY 1, 2, 3"""))
def qq_line(spark, sf):
    q = stats.qq_line(stats.qq_points(labelled(spark, sf)))
    return q.select("split", "feature", "y", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


# ---- ranking of univariate results with importances ----

MET = f"""{FDR}, me AS (SELECT feature, abs(d) AS abs_cohens_d, abs(delta) AS abs_cliffs_delta, greatest(a, 1 - a) AS auc, p, p_bh_fdr FROM st JOIN bh USING (split, feature) WHERE split = 'control_vs_all'),
im AS (SELECT feature, round(avg(value), 6) AS importance, round(max(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY 1),
ij AS (SELECT me.*, importance AS mdi, mean AS permutation, std AS permutation_std, rank() OVER (ORDER BY importance DESC) AS rank_mdi, rank() OVER (ORDER BY mean DESC) AS rank_permutation,
  rank() OVER (ORDER BY abs_cohens_d DESC) AS rank_abs_d, rank() OVER (ORDER BY abs_cliffs_delta DESC) AS rank_abs_delta, rank() OVER (ORDER BY auc DESC) AS rank_auc, rank() OVER (ORDER BY p) AS rank_p
  FROM me JOIN im USING (feature))"""
RANKS = "rank_mdi, rank_permutation, rank_abs_d, rank_abs_delta, rank_auc, rank_p"


def joined(spark, sf):
    t = stats.univariate_table(labelled(spark, sf).filter("split = 'control_vs_all'"), "u").drop("split")
    im = long(spark, sf).groupBy("feature").agg(F.round(F.avg("value"), 6).alias("importance"), F.round(F.max("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
    return report.importance_join(t, im.select("feature", "importance"), im.select("feature", "mean", "std"))


@query("importance_join", with_views("features", body=f", {MET} SELECT feature, round(mdi, 3) AS mdi, round(permutation, 3) AS permutation, {RANKS} FROM ij"))
def importance_join(spark, sf):
    return joined(spark, sf).select("feature", F.round("mdi", 3).alias("mdi"), F.round("permutation", 3).alias("permutation"), *RANKS.split(", "))


@query("rank_correlations", with_views("features", body=f""", {MET},
lr AS (SELECT feature, name, r FROM ij UNPIVOT (r FOR name IN ({RANKS}))), mr AS (SELECT feature, name, rank() OVER (PARTITION BY name ORDER BY r) + (count(*) OVER (PARTITION BY name, r) - 1) / 2 AS m FROM lr)
SELECT x.name AS a, y.name AS b, round(corr(x.m, y.m), 6) AS rho FROM mr x JOIN mr y USING (feature) GROUP BY 1, 2"""))
def rank_correlations(spark, sf):
    return report.rank_correlations(joined(spark, sf)).withColumn("rho", F.round("rho", 6))


@query("topk_abs", with_views("features", body=f", {STAT} SELECT split, feature, round(delta, 6) AS cliffs_delta FROM st ORDER BY abs(delta) DESC, feature LIMIT 6"))
def topk_abs(spark, sf):
    s = stats.mann_whitney(labelled(spark, sf)).withColumn("cliffs_delta", stats.cliffs_delta())
    return report.top_abs(s, "cliffs_delta", 6).select("split", "feature", F.round("cliffs_delta", 6).alias("cliffs_delta"))


@query("topk_combined_rank", with_views("features", body=f", {MET} SELECT feature, rank_mdi + rank_abs_d AS combined FROM ij ORDER BY 2, 1 LIMIT 4"))
def topk_combined_rank(spark, sf):
    return report.top_combined_rank(joined(spark, sf), "rank_mdi", "rank_abs_d", 4).select("feature", "combined")


@query("topk_significant", with_views("features", body=f", {FDR} SELECT split, feature, round(-log10(greatest(p, 1e-300)), 6) AS neg_log10_p, p_bh_fdr < 0.05 AS significant FROM bh ORDER BY p, feature LIMIT 10"))
def topk_significant(spark, sf):
    t = report.top_significant(stats.univariate_table(labelled(spark, sf), "u"), 10)
    return t.select("split", "feature", F.round("neg_log10_p", 6).alias("neg_log10_p"), F.col("`significant_fdr_0.05`").alias("significant"))


# ---- comparison of two models ----

SCORES = "ls AS (SELECT id, y_true, model, score FROM oof UNPIVOT (score FOR model IN (score_a, score_b)))"
DELONG = f"""{SCORES},
mid AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY model, y_true ORDER BY score) + (count(*) OVER (PARTITION BY model, y_true, score) - 1) / 2 AS rc,
  count(*) OVER (PARTITION BY model) - count(*) OVER (PARTITION BY model, y_true) AS other FROM ls),
dc AS (SELECT model, id, y_true, CASE WHEN y_true = 1 THEN (ra - rc) / other ELSE 1 - (ra - rc) / other END AS component FROM mid)"""


@query("delong_components", with_views("oof", body=f", {DELONG} SELECT model, id, y_true, round(component, 9) AS component FROM dc"))
def delong_components(spark, sf):
    d = compare.delong_components(compare.long_scores(fx.oof(spark, sf), ["score_a", "score_b"]))
    return d.withColumn("component", F.round("component", 9))


@query("delong_test", with_views("oof", body=f""", {DELONG}, {SIMPSON},
w AS (SELECT id, y_true, max(component) FILTER (WHERE model = 'score_a') AS a, max(component) FILTER (WHERE model = 'score_b') AS b FROM dc GROUP BY 1, 2),
s AS (SELECT avg(a) FILTER (WHERE y_true = 1) AS auc_a, avg(b) FILTER (WHERE y_true = 1) AS auc_b,
  var_samp(a) FILTER (WHERE y_true = 1) / count(*) FILTER (WHERE y_true = 1) + var_samp(a) FILTER (WHERE y_true = 0) / count(*) FILTER (WHERE y_true = 0) AS var_a,
  var_samp(b) FILTER (WHERE y_true = 1) / count(*) FILTER (WHERE y_true = 1) + var_samp(b) FILTER (WHERE y_true = 0) / count(*) FILTER (WHERE y_true = 0) AS var_b,
  covar_samp(a, b) FILTER (WHERE y_true = 1) / count(*) FILTER (WHERE y_true = 1) + covar_samp(a, b) FILTER (WHERE y_true = 0) / count(*) FILTER (WHERE y_true = 0) AS cov_ab FROM w),
z AS (SELECT *, (auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab) AS z FROM s),
p AS (SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000, 2) / 2)) * abs(any_value(z)) / 6000 / sqrt(2 * pi()) AS p FROM z, si)
SELECT round(auc_a, 9) AS auc_a, round(auc_b, 9) AS auc_b, round(var_a, 9) AS var_a, round(var_b, 9) AS var_b, round(cov_ab, 9) AS cov_ab, round(z, 6) AS z, round(p, 6) AS p_value,
  round(auc_a - 1.959963984540054 * sqrt(var_a), 6) AS ci_a_lower, round(auc_b + 1.959963984540054 * sqrt(var_b), 6) AS ci_b_upper, p < 0.05 AS significant FROM z, p"""))
def delong_test(spark, sf):
    d = compare.delong_test(fx.oof(spark, sf), "score_a", "score_b")
    r = {"auc_a": 9, "auc_b": 9, "var_a": 9, "var_b": 9, "cov_ab": 9, "z": 6, "p_value": 6, "ci_a_lower": 6, "ci_b_upper": 6}
    return d.select(*[F.round(c, n).alias(c) for c, n in r.items()], "significant")


@query("oof_alignment", """
SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS only_first, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_second,
  count(*) FILTER (WHERE a.quality <> b.toxic) AS label_mismatch FROM (SELECT * FROM labels) a FULL JOIN (SELECT * FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id""")
def oof_alignment(spark, sf):
    lab = table(spark, sf, "labels")
    a = lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"))
    b = lab.filter("quality = 1").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y_true"))
    return compare.check_aligned(a, b)


N_BOOT = 10_000
DRAWS = f"""num AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM oof),
d1 AS (SELECT b.b, n, ((i + 1) * 48271 + (b.b + 1) * 69621 + 42) % 2147483647 AS x FROM num, (SELECT unnest(range({N_BOOT})) AS b) b),
d2 AS (SELECT b, n, x, (x * x + 12387) % 2147483647 AS y FROM d1),
dw AS (SELECT b, ((y * y + x) % 2147483647) % n AS i, count(*) AS w FROM d2 GROUP BY 1, 2),
bl AS (SELECT b, y_true, w, model, score FROM (SELECT b, y_true, w, score_a, score_b FROM dw JOIN num USING (i)) UNPIVOT (score FOR model IN (score_a, score_b))),
bv AS (SELECT b, model, score, sum(CASE WHEN y_true = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y_true = 0 THEN w ELSE 0 END) AS q FROM bl GROUP BY 1, 2, 3),
bc AS (SELECT *, sum(q) OVER (PARTITION BY b, model ORDER BY score) AS cq FROM bv),
ba AS (SELECT b, model, sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS auc FROM bc GROUP BY 1, 2),
bd AS (SELECT b, max(auc) FILTER (WHERE model = 'score_a') AS auc_1, max(auc) FILTER (WHERE model = 'score_b') AS auc_2 FROM ba GROUP BY 1)"""


def deltas(spark, sf):
    return compare.bootstrap_deltas(fx.oof(spark, sf), "score_a", "score_b", N_BOOT)


@query("bootstrap_deltas", with_views("oof", body=f", {DRAWS} SELECT b, round(auc_1, 9) AS auc_1, round(auc_2, 9) AS auc_2, round(auc_1 - auc_2, 9) AS delta FROM bd"))
def bootstrap_deltas(spark, sf):
    return deltas(spark, sf).select(F.col("replicate").alias("b"), *[F.round(c, 9).alias(c) for c in ("auc_1", "auc_2", "delta")])


@query("bootstrap_auc", with_views("oof", body=f""", {DRAWS}, {SCORES},
ov AS (SELECT model, score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS q FROM ls GROUP BY 1, 2),
oc AS (SELECT *, sum(q) OVER (PARTITION BY model ORDER BY score) AS cq FROM ov), oa AS (SELECT model, sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS auc FROM oc GROUP BY 1)
SELECT round((SELECT auc FROM oa WHERE model = 'score_a'), 9) AS auc_1, round((SELECT auc FROM oa WHERE model = 'score_b'), 9) AS auc_2,
  round((SELECT auc FROM oa WHERE model = 'score_a') - (SELECT auc FROM oa WHERE model = 'score_b'), 9) AS delta_auc, avg(CASE WHEN auc_1 - auc_2 <= 0 THEN 1 ELSE 0 END) AS p_value,
  round(quantile_cont(auc_1 - auc_2, 0.025), 9) AS ci_lower, round(quantile_cont(auc_1 - auc_2, 0.975), 9) AS ci_upper FROM bd"""))
def bootstrap_auc(spark, sf):
    d = compare.bootstrap_auc(fx.oof(spark, sf), "score_a", "score_b", N_BOOT)
    return d.select(*[F.round(c, 9).alias(c) if c != "p_value" else F.col(c) for c in d.columns])


@query("bootstrap_histogram", with_views("oof", body=f""", {DRAWS},
dd AS (SELECT auc_1 - auc_2 AS v FROM bd), e AS (SELECT min(v) AS lo, max(v) AS hi FROM dd),
h AS (SELECT CAST(coalesce(least(59, floor((v - lo) / (hi - lo) * 60)), 0) AS INTEGER) AS bin, count(*) AS c FROM dd, e GROUP BY 1)
SELECT 'delta' AS feature, CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 60 * g.bin, 9) AS "left", round(lo + (hi - lo) / 60 * (g.bin + 1), 9) AS "right", coalesce(c, 0) AS count
FROM (SELECT unnest(range(60)) AS bin) g CROSS JOIN e LEFT JOIN h ON h.bin = g.bin"""))
def bootstrap_histogram(spark, sf):
    d = cut(deltas(spark, sf)).select(F.lit("delta").alias("feature"), F.col("delta").alias("value"))
    return report.histogram(d, n_bins=60).withColumns({c: F.round(c, 9) for c in ("left", "right")})


@query("roc_curve", with_views("oof", body=f""", {SCORES},
v AS (SELECT model, score, sum(y_true) AS p, sum(1 - y_true) AS q FROM ls GROUP BY 1, 2)
SELECT model, score AS threshold, round(sum(q) OVER w / sum(q) OVER (PARTITION BY model), 9) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY model), 9) AS tpr FROM v
WINDOW w AS (PARTITION BY model ORDER BY score DESC)"""))
def roc_curve(spark, sf):
    r = compare.roc_curve(compare.long_scores(fx.oof(spark, sf), ["score_a", "score_b"]))
    return r.withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query("roc_auc", with_views("oof", body=f""", {SCORES}, rr AS (SELECT model, y_true, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM ls)
SELECT model, count(*) FILTER (WHERE y_true = 1) AS n_pos, count(*) FILTER (WHERE y_true = 0) AS n_neg,
  round((sum(r) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2) / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true = 0)), 9) AS auc FROM rr GROUP BY 1"""))
def roc_auc(spark, sf):
    return compare.roc_auc(compare.long_scores(fx.oof(spark, sf), ["score_a", "score_b"])).withColumn("auc", F.round("auc", 9))


# ---- labelled vectors ----

DIM = 64
COLS = tuple(f"x{i}" for i in range(DIM))


def matrix(spark, sf, binary=True):
    e = table(spark, sf, "embeddings")
    y = (F.col("label") < 5).cast("int") if binary else F.col("label").cast("int")
    return e.select(F.col("vec_id").alias("id"), y.alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLS)])


FOLDED = """fo AS (SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY (s * s + 42) % 2147483647, id) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT vec_id AS id, label AS y, (vec_id * 48271 + 42) % 2147483647 AS s FROM embeddings))"""
MAJ = f"""{FOLDED}, cn AS (SELECT fold, y, count(*) AS n FROM fo GROUP BY 1, 2),
pf AS (SELECT f.fold, cn.y, sum(cn.n) AS n FROM (SELECT DISTINCT fold FROM fo) f JOIN cn ON cn.fold <> f.fold GROUP BY 1, 2),
mj AS (SELECT fold, y AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) AS rn FROM pf) WHERE rn = 1),
pr AS (SELECT 'Baseline (majority)' AS model, fold, id, y AS y_true, y_pred FROM fo JOIN mj USING (fold))"""


def folded(spark, sf):
    return compare.stratified_folds(matrix(spark, sf, False).select("id", "y"), 5)


@query("stratified_folds", f"WITH {FOLDED} SELECT id, y, fold FROM fo")
def stratified_folds(spark, sf):
    return folded(spark, sf)


@query("majority_baseline", f"WITH {MAJ} SELECT * FROM pr")
def majority_baseline(spark, sf):
    return compare.majority_baseline(folded(spark, sf))


@query("class_weights", "SELECT vec_id AS id, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)), 9) AS weight FROM embeddings")
def class_weights(spark, sf):
    return ml.class_weights(matrix(spark, sf, False).select("id", "y")).select("id", F.round("weight", 9).alias("weight"))


PRED = """pr AS (SELECT m.model, fold, doc_id AS id, quality AS y_true, CASE m.model WHEN 'a' THEN CAST(n_chars > 600 AS INTEGER) ELSE CAST(doc_id * 7919 % 1000 > 400 AS INTEGER) END AS y_pred
  FROM (SELECT *, doc_id % 4 AS fold FROM labels JOIN documents USING (doc_id)), (VALUES ('a'), ('b')) m(model))"""


def preds(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    b = d.select((F.col("doc_id") % 4).alias("fold"), F.col("doc_id").alias("id"), F.col("quality").alias("y_true"),
                 (F.col("n_chars") > 600).cast("int").alias("_a"), (F.col("doc_id") * 7919 % 1000 > 400).cast("int").alias("_b"))
    return b.select("fold", "id", "y_true", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("_a").alias("y_pred")), F.struct(F.lit("b").alias("model"), F.col("_b").alias("y_pred")))).alias("_s")).select("fold", "id", "y_true", "_s.*")


def _metrics_sql(binary: bool) -> str:
    pick = (lambda x: f"coalesce(max({x}) FILTER (WHERE k = 1), 0)") if binary else (lambda x: f"sum({x} * sup) / sum(sup)")
    return f""", ks AS (SELECT DISTINCT model, fold, y_true AS k FROM pr UNION SELECT DISTINCT model, fold, y_pred FROM pr),
pc AS (SELECT ks.model, ks.fold, ks.k, count(*) FILTER (WHERE y_true = k) AS sup, count(*) FILTER (WHERE y_pred = k) AS prd, count(*) FILTER (WHERE y_pred = k AND y_true = k) AS hit
  FROM ks JOIN pr ON pr.model = ks.model AND pr.fold = ks.fold GROUP BY 1, 2, 3),
mt AS (SELECT *, coalesce(hit / nullif(prd, 0), 0) AS prec, coalesce(hit / nullif(sup, 0), 0) AS rec, coalesce(2 * hit / nullif(sup + prd, 0), 0) AS f FROM pc),
fm AS (SELECT model, fold, sum(hit) / sum(sup) AS accuracy, avg(rec) FILTER (WHERE sup > 0) AS balanced_accuracy, {pick('f')} AS f1, {pick('prec')} AS "precision", {pick('rec')} AS recall FROM mt GROUP BY 1, 2)"""


def _round_metrics(d, suffixes=("",)):
    return d.withColumns({f"{m}{s}": F.round(f"{m}{s}", 9) for m in compare.METRICS for s in suffixes})


_M = ", ".join(f'round("{m}", 9) AS "{m}"' for m in compare.METRICS)


@query("classification_metrics", f"WITH {PRED} {_metrics_sql(True)} SELECT model, fold, {_M} FROM fm")
def classification_metrics(spark, sf):
    return _round_metrics(compare.classification_metrics(preds(spark, sf)))


@query("classification_metrics_weighted", f"WITH {MAJ} {_metrics_sql(False)} SELECT model, fold, {_M} FROM fm")
def classification_metrics_weighted(spark, sf):
    return _round_metrics(compare.classification_metrics(compare.majority_baseline(folded(spark, sf)), average="weighted"))


@query("confusion_matrix", f"WITH {PRED} SELECT model, y_true, y_pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model, y_true), 9) AS share FROM pr GROUP BY 1, 2, 3")
def confusion_matrix(spark, sf):
    return compare.confusion_matrix(preds(spark, sf)).withColumn("share", F.round("share", 9))


_CV = ", ".join(f'round(avg("{m}"), 9) AS {m}_mean, round(stddev_samp("{m}"), 9) AS {m}_std' for m in compare.METRICS)


@query("cv_summary", f"WITH {PRED} {_metrics_sql(True)} SELECT model, {_CV} FROM fm GROUP BY 1")
def cv_summary(spark, sf):
    return _round_metrics(compare.cv_summary(compare.classification_metrics(preds(spark, sf))), ("_mean", "_std"))


@query("sort_summary", f"WITH {PRED} {_metrics_sql(True)} SELECT model, round(avg(balanced_accuracy), 9) AS balanced_accuracy_mean FROM fm GROUP BY 1 ORDER BY 2 DESC")
def sort_summary(spark, sf):
    s = compare.cv_summary(compare.classification_metrics(preds(spark, sf)))
    return report.sort_summary(s).select("model", F.round("balanced_accuracy_mean", 9).alias("balanced_accuracy_mean"))


@query("task_table", f"""WITH {PRED} {_metrics_sql(True)}
SELECT model, round(avg(balanced_accuracy) FILTER (WHERE fold < 2), 9) AS first_half, round(avg(balanced_accuracy) FILTER (WHERE fold >= 2), 9) AS second_half FROM fm GROUP BY 1""")
def task_table(spark, sf):
    m = compare.classification_metrics(preds(spark, sf)).withColumn("task", F.when(F.col("fold") < 2, "first_half").otherwise("second_half"))
    t = compare.task_table(compare.cv_summary(m, ("model", "task")))
    return t.select("model", F.round("first_half", 9).alias("first_half"), F.round("second_half", 9).alias("second_half"))


@query("probability_strip", """
SELECT 'm' AS model, doc_id AS id, quality AS y_true, n_chars / (n_chars + 500e0) AS prob, count(*) OVER (PARTITION BY quality) AS n_class FROM labels JOIN documents USING (doc_id)""")
def probability_strip(spark, sf):
    p = F.col("score_a") / (F.col("score_a") + 500.0)
    o = fx.oof(spark, sf).select(F.lit("m").alias("model"), "id", "y_true", F.array(1 - p, p).alias("probs"))
    return compare.probability_strip(o)


ROWS = "fr AS (SELECT CAST(substr(subject_id, 2) AS BIGINT) AS id, * EXCLUDE (subject_id, segment_group) FROM features)"


def rows(spark, sf):
    f = fx.features(spark, sf)
    return f.select(F.substring("subject_id", 2, 20).cast("long").alias("id"), *FEATURES)


@query("impute_simple", with_views("features", body=f", {ROWS} SELECT id, {', '.join(f'round(coalesce({c}, (SELECT avg({c}) FROM fr)), 6) AS {c}' for c in FEATURES)} FROM fr"))
def impute_simple(spark, sf):
    r = rows(spark, sf).select("id", *FEATURES)
    return ml.impute_simple(r, r, FEATURES, "mean")[0].select("id", *[F.round(c, 6).alias(c) for c in FEATURES])


def _knn_sql() -> str:
    dist = " + ".join(f"coalesce(pow(a.{c} - b.{c}, 2), 0)" for c in FEATURES)
    shared = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INTEGER)" for c in FEATURES)
    per = ", ".join(
        f"k_{c} AS (SELECT id, avg({c}) AS v FROM (SELECT ai AS id, {c}, row_number() OVER (PARTITION BY ai ORDER BY dist, bi) AS rn FROM pairs WHERE {c} IS NOT NULL AND missing_{c}) WHERE rn <= 5 GROUP BY 1)" for c in FEATURES)
    return f""", {ROWS}, pairs AS (SELECT a.id AS ai, b.id AS bi, sqrt(greatest({dist}, 0) * {len(FEATURES)} / ({shared})) AS dist, {', '.join(f'b.{c}, a.{c} IS NULL AS missing_{c}' for c in FEATURES)}
  FROM (SELECT * FROM fr WHERE {' OR '.join(f'{c} IS NULL' for c in FEATURES)}) a, fr b WHERE {shared} > 0), {per}
SELECT fr.id, {', '.join(f'round(coalesce(fr.{c}, k_{c}.v, (SELECT avg({c}) FROM fr)), 4) AS {c}' for c in FEATURES)} FROM fr {' '.join(f'LEFT JOIN k_{c} ON k_{c}.id = fr.id' for c in FEATURES)}"""


@query("impute_knn", with_views("features", body=_knn_sql()))
def impute_knn(spark, sf):
    r = rows(spark, sf)
    return ml.impute_knn(r, r, FEATURES).select("id", *[F.round(c, 4).alias(c) for c in FEATURES])


@query("standardise", with_views("features", body=f", {ROWS} SELECT id, {', '.join(f'round(({c} - (SELECT avg({c}) FROM fr)) / (SELECT stddev_pop({c}) FROM fr), 6) AS {c}' for c in FEATURES)} FROM fr"))
def standardise(spark, sf):
    r = rows(spark, sf)
    return ml.standardise(r, [], FEATURES)[0].select("id", *[F.round(c, 6).alias(c) for c in FEATURES])


# ---- classifiers: rows-only checks ----

def _classifier(name):
    def run(spark, sf):
        m = cut(ml.standardise(matrix(spark, sf), [], COLS)[0])
        return ml.predict(ml.fit(m, COLS, name), m, name)

    return run


for _key, _name in (("clf_logistic", "Logistic Regression"), ("clf_linear_svm", "SVM"), ("clf_random_forest", "Random Forest"), ("clf_boosted_trees", "Boosted Trees")):
    query(_key)(_classifier(_name))


@query("kfold_cv")
def kfold_cv(spark, sf):
    return ml.cross_validate(matrix(spark, sf), COLS, ml.DEFAULTS, k=5)


@query("nested_cv")
def nested_cv(spark, sf):
    return ml.nested_cross_validate(matrix(spark, sf), COLS, ["Random Forest"], k_outer=2, k_inner=2, n_iter=2,
                                    spaces={"Random Forest": {"n_estimators": [5, 10], "max_depth": [3, 5]}})


@query("mdi_importance")
def mdi_importance(spark, sf):
    m = cut(ml.standardise(matrix(spark, sf), [], COLS)[0])
    return ml.mdi_importance(ml.fit(m, COLS, "Random Forest"), spark, COLS, len(COLS))


def _leading(name: str, start: str, squarings: int = 16) -> str:
    """SQL of the leading eigenvector of the symmetric table ``start`` (i, j, v): its powers by repeated squaring."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FILTER (WHERE i = j) FROM {start}) AS v FROM {start})"]
    for k in range(squarings):
        steps += [f"{name}s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY 1, 2)",
                  f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FILTER (WHERE i = j) FROM {name}s{k}) AS v FROM {name}s{k})"]
    last = f"{name}{squarings}"
    column = f"(SELECT * FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1))"
    return ", ".join([*steps, f"{name} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {column})"])


# Scores on the first two components; their sign is that which makes the smallest id's score positive.
PCA_SQL = f"""WITH raw AS (SELECT vec_id AS id, k AS i, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, range({DIM}) r(k)),
z AS MATERIALIZED (SELECT id, i, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS x FROM raw WINDOW w AS (PARTITION BY i)),
c AS MATERIALIZED (SELECT a.i, b.i AS j, avg(a.x * b.x) AS v FROM z a JOIN z b USING (id) GROUP BY 1, 2),
{_leading("p", "c")},
top AS (SELECT sum(a.v * c.v * b.v) AS size FROM c JOIN p a ON a.i = c.i JOIN p b ON b.i = c.j),
d AS MATERIALIZED (SELECT c.i, c.j, c.v - size * a.v * b.v AS v FROM c JOIN p a ON a.i = c.i JOIN p b ON b.i = c.j, top),
{_leading("q", "d")},
pc AS (SELECT id, sum(x * p.v) AS a, sum(x * q.v) AS b FROM z JOIN p USING (i) JOIN q USING (i) GROUP BY 1)
SELECT id, CAST(label < 5 AS INTEGER) AS y, round(a * (SELECT sign(min_by(a, id)) FROM pc), 4) AS pc1, round(b * (SELECT sign(min_by(b, id)) FROM pc), 4) AS pc2 FROM pc JOIN embeddings ON vec_id = id"""


@query("pca_2d", PCA_SQL)
def pca_2d(spark, sf):
    scores = ml.pca_2d(matrix(spark, sf), COLS)[0]
    sign = scores.agg(*[F.signum(F.min_by(c, "id")).alias(f"_{c}") for c in ("pc1", "pc2")], F.lit(1).alias("_one"))
    return scores.withColumn("_one", F.lit(1)).join(F.broadcast(sign), "_one").select("id", "y", *[F.round(F.col(c) * F.col(f"_{c}"), 4).alias(c) for c in ("pc1", "pc2")])


@query("compare_models")
def compare_models(spark, sf):
    """All columns against the first half of them: pooled predictions of both by every model, then the paired bootstrap."""
    return training.compare_models(matrix(spark, sf), COLS, COLS[:32], ml.DEFAULTS, k=5, n_boot=N_BOOT)


@query("macro_auc", """
WITH z AS (SELECT label AS y, k, embedding[k + 1] AS s FROM embeddings, range(64) r(k)),
c AS (SELECT k, CAST(y = k AS INTEGER) AS h, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS r FROM z),
a AS (SELECT k, (sum(r) FILTER (WHERE h = 1) - sum(h) * (sum(h) + 1) / 2) / nullif(sum(h) * sum(1 - h), 0) AS auc FROM c GROUP BY 1)
SELECT 'm' AS model, round(avg(auc), 9) AS auc FROM a""")
def macro_auc(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("m").alias("model"), F.col("label").alias("y_true"), F.col("embedding").cast("array<double>").alias("probs"))
    return compare.macro_auc(e).withColumn("auc", F.round("auc", 9))


@query("one_vs_rest_auc", """
WITH z AS (SELECT label AS y, k AS class, embedding[k + 1] AS s FROM embeddings, range(10) r(k)),
c AS (SELECT class, CAST(y = class AS INTEGER) AS h, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2 AS r FROM z)
SELECT 'm' AS model, CAST(class AS INTEGER) AS class, sum(h) AS n_pos, sum(1 - h) AS n_neg,
  round((sum(r) FILTER (WHERE h = 1) - sum(h) * (sum(h) + 1) / 2) / nullif(sum(h) * sum(1 - h), 0), 9) AS auc FROM c GROUP BY class""")
def one_vs_rest_auc(spark, sf):
    """Each class against the rest, the first ten components as its scores."""
    e = table(spark, sf, "embeddings").select(F.lit("m").alias("model"), F.col("label").alias("y_true"), F.col("embedding").cast("array<double>").alias("probs"))
    return compare.roc_auc(compare.one_vs_rest(e, range(10)), ["model", "class"]).withColumn("auc", F.round("auc", 9))
