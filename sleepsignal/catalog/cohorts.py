"""Cohort joins, labels, report tables and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.fixtures import DAY, FEATURES, SQL, sql_choose, table, with_views
from sleepsignal.catalog.registry import query
from sleepsignal.operators import clean, cohort, report
from sleepsignal.operators.features import patient
from sleepsignal.schemas import KEY, T, require

GROUPS = ("Control", "PD(-RBD)", "PD(+RBD)", "iRBD", "PLM")


def sheet(spark, sf):
    """Patient sheet: one row per order, so customers repeat and some are missing; labels from the customer's segment."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice")
    g = fx.choose(F.col("c_mktsegment"), fx.GROUP_OF_SEGMENT)
    flags = [F.when(F.col("c_acctbal") > 0, (g == n).cast("int")).alias(n) for n in GROUPS]
    return o.join(c, "c_custkey").select(
        F.concat(F.lit("DCSM_"), "c_custkey", F.lit("_a")).alias("patient_id"), F.col("o_orderkey").alias("row_id"), *flags,
        F.col("o_orderpriority").alias("Sex"), F.col("o_totalprice").alias("BMI"))


SQL["sheet"] = f"""
SELECT 'DCSM_' || c_custkey || '_a' AS patient_id, o_orderkey AS row_id,
  {', '.join(f'''CASE WHEN c_acctbal > 0 THEN CAST({sql_choose('c_mktsegment', fx.GROUP_OF_SEGMENT)} = '{g}' AS INTEGER) END AS "{g}"''' for g in GROUPS)},
  o_orderpriority AS Sex, o_totalprice AS BMI FROM orders JOIN customer ON o_custkey = c_custkey"""

ONE_LABEL = f"""one AS (SELECT patient_id, {', '.join(f'coalesce(arg_min_null("{g}", row_id), 0) AS "{g}"' for g in GROUPS)} FROM sheet GROUP BY 1)"""


def subjects(spark, sf):
    """Session names: the identifier inside a longer name for even balances, a bare name otherwise."""
    c = table(spark, sf, "customer")
    ident = F.concat(F.lit("DCSM_"), "c_custkey", F.lit("_a"))
    return c.select(F.when(F.col("c_nationkey") < 20, F.concat(ident, F.lit("_merged.csv"))).otherwise(F.concat(F.lit("other-"), "c_custkey")).alias("subject_id"))


SQL["subjects"] = """SELECT CASE WHEN c_nationkey < 20 THEN 'DCSM_' || c_custkey || '_a_merged.csv' ELSE 'other-' || c_custkey END AS subject_id FROM customer"""
LABELLED = f"""pat AS (SELECT s.subject_id, s.pid AS patient_id, {', '.join(f'coalesce(o."{g}", 0) AS "{g}"' for g in GROUPS)} FROM
  (SELECT subject_id, coalesce(nullif(regexp_extract(subject_id, '(DCSM_\\d+_[a-zA-Z])', 1), ''), subject_id) AS pid FROM subjects) s
  LEFT JOIN one o ON o.patient_id = s.pid)"""
GROUP_RULE = """CASE WHEN "PLM" = 1 THEN 'Control' WHEN "iRBD" = 1 THEN 'iRBD' WHEN "PD(+RBD)" = 1 THEN 'PD(+RBD)' WHEN "PD(-RBD)" = 1 THEN 'PD(-RBD)'
  WHEN "Control" + "PD(-RBD)" + "PD(+RBD)" + "iRBD" + "PLM" > 0 THEN 'Control' ELSE 'Unknown' END"""


def labelled(spark, sf):
    return patient.patient_features(subjects(spark, sf), sheet(spark, sf))


@query("id_extract", with_views("subjects", body="""
SELECT subject_id, coalesce(nullif(regexp_extract(subject_id, '(DCSM_\\d+_[a-zA-Z])', 1), ''), subject_id) AS session FROM subjects"""))
def id_extract(spark, sf):
    return subjects(spark, sf).select("subject_id", clean.id_extract(F.col("subject_id")).alias("session"))


@query("patient_lookup", with_views("sheet", "subjects", body=f", {ONE_LABEL}, {LABELLED} SELECT * FROM pat"))
def patient_lookup(spark, sf):
    return labelled(spark, sf)


@query("patient_dim", with_views("sheet", body=f", {ONE_LABEL} SELECT * FROM one"))
def patient_dim(spark, sf):
    s = sheet(spark, sf)
    return patient.patient_features(s.select(F.col("patient_id").alias("subject_id")).distinct(), s).drop("subject_id")


@query("patient_info_left", with_views("sheet", "subjects", body=f"""
, {ONE_LABEL}, {LABELLED} SELECT p.patient_id, p.subject_id, s.Sex, s.BMI FROM pat p LEFT JOIN sheet s USING (patient_id)"""))
def patient_info_left(spark, sf):
    return cohort.patient_info(labelled(spark, sf).select("patient_id", "subject_id"), sheet(spark, sf), "patient_id", ["Sex", "CPAP", "BMI"])


@query("patient_unmatched", with_views("sheet", "subjects", body=f"""
, {ONE_LABEL}, {LABELLED} SELECT patient_id, subject_id FROM pat WHERE patient_id NOT IN (SELECT patient_id FROM sheet)"""))
def patient_unmatched(spark, sf):
    return cohort.unmatched(labelled(spark, sf).select("patient_id", "subject_id"), sheet(spark, sf), "patient_id")


@query("assign_group", with_views("sheet", "subjects", body=f', {ONE_LABEL}, {LABELLED} SELECT subject_id, {GROUP_RULE} AS "group" FROM pat'))
def assign_group(spark, sf):
    d = labelled(spark, sf)
    return d.select("subject_id", cohort.assign_group(d).alias("group"))


_INFO = GROUP_RULE.replace('"Control" + "PD(-RBD)" + "PD(+RBD)" + "iRBD" + "PLM" > 0', 'coalesce("Control", "PD(-RBD)", "PD(+RBD)", "iRBD", "PLM") IS NOT NULL')


@query("assign_group_variants", with_views("sheet", body=f"""
SELECT row_id, {_INFO} AS group_info, CASE WHEN "Control" = 1 OR "PLM" = 1 THEN 'Control' WHEN "iRBD" = 1 THEN 'iRBD' WHEN "PD(+RBD)" = 1 THEN 'PD(+RBD)'
  WHEN "PD(-RBD)" = 1 THEN 'PD(-RBD)' ELSE 'Control' END AS group_plot FROM sheet"""))
def assign_group_variants(spark, sf):
    s = sheet(spark, sf)
    return s.select("row_id", cohort.assign_group(s, "info").alias("group_info"), cohort.assign_group(s, "plot").alias("group_plot"))


def _label_sql(mapping):
    return "CASE " + " ".join(f"WHEN \"group\" = '{g}' THEN {v}" for g, v in mapping.items()) + " END"


@query("make_labels", with_views("sheet", "subjects", body=f""", {ONE_LABEL}, {LABELLED}, g AS (SELECT subject_id, {GROUP_RULE} AS "group" FROM pat)
{' UNION ALL '.join(f"SELECT '{t}' AS task, subject_id, CAST({_label_sql(m)} AS INTEGER) AS y FROM g WHERE {_label_sql(m)} IS NOT NULL" for t, m in (*cohort.BINARY_LABELS.items(), ('multiclass', cohort.MULTICLASS_LABELS)))}"""))
def make_labels(spark, sf):
    d = labelled(spark, sf)
    d = d.select("subject_id", cohort.assign_group(d).alias("group"))
    parts = [cohort.make_labels(d, "binary", t).select(F.lit(t).alias("task"), "subject_id", "y") for t in cohort.BINARY_LABELS]
    out = cohort.make_labels(d, "multiclass").select(F.lit("multiclass").alias("task"), "subject_id", "y")
    for p in parts:
        out = out.unionByName(p)
    return out


@query("class_counts", with_views("features", body="SELECT CAST(y AS INTEGER) AS y, count(*) AS n FROM (SELECT CASE segment_group WHEN 'Control' THEN 0 WHEN 'iRBD' THEN 1 WHEN 'PD(+RBD)' THEN 1 END AS y FROM features) WHERE y IS NOT NULL GROUP BY 1"))
def class_counts(spark, sf):
    return cohort.class_counts(cohort.make_labels(fx.features(spark, sf), "binary", "control_vs_all", "segment_group"))


@query("label_audit", with_views("sheet", "subjects", body=f""", {ONE_LABEL}, {LABELLED}
SELECT count(*) FILTER (WHERE t > 0) AS with_label, count(*) FILTER (WHERE t = 0) AS without_label,
  {', '.join(f'count(*) FILTER (WHERE "{g}" = 1) AS "n_{g}"' for g in GROUPS)}
FROM (SELECT *, {' + '.join(f'"{g}"' for g in GROUPS)} AS t FROM pat)"""))
def label_audit(spark, sf):
    return cohort.label_audit(labelled(spark, sf))


@query("unlabelled_ids", with_views("sheet", "subjects", body=f""", {ONE_LABEL}, {LABELLED}
SELECT subject_id FROM pat WHERE {' + '.join(f'"{g}"' for g in GROUPS)} = 0"""))
def unlabelled_ids(spark, sf):
    return cohort.unlabelled_ids(labelled(spark, sf), "subject_id")


def modules(spark, sf):
    """Module tables that overlap in subjects and repeat one column."""
    f = fx.features(spark, sf)
    a = f.filter("balance > 1000").select("subject_id", "balance")
    b = f.filter("order_count IS NOT NULL").select("subject_id", "order_count", (F.col("balance") * 2).alias("balance"))
    d = f.filter("price_std IS NOT NULL").select("subject_id", "price_std", "price_max")
    return [a, b, d]


@query("module_outer_merge", with_views("features", body="""
SELECT coalesce(a.subject_id, b.subject_id, d.subject_id) AS subject_id, a.balance, b.order_count, d.price_std, d.price_max
FROM (SELECT * FROM features WHERE balance > 1000) a FULL JOIN (SELECT * FROM features WHERE order_count IS NOT NULL) b USING (subject_id)
FULL JOIN (SELECT * FROM features WHERE price_std IS NOT NULL) d ON d.subject_id = coalesce(a.subject_id, b.subject_id)"""))
def module_outer_merge(spark, sf):
    return cohort.outer_merge(modules(spark, sf))


@query("waso_append", with_views("features", body="""
SELECT f.subject_id, f.balance, CASE WHEN price_std IS NOT NULL THEN quantity_mean END AS waso_min FROM features f"""))
def waso_append(spark, sf):
    f = fx.features(spark, sf)
    w = f.filter("price_std IS NOT NULL").select("subject_id", F.col("quantity_mean").alias("waso_min"))
    return cohort.append_column(f.select("subject_id", "balance", F.lit(0.0).alias("waso_min")), w, "subject_id", "waso_min")


@query("coalesce_suffixes", with_views("features", body="SELECT subject_id, coalesce(price_std, balance) AS Control FROM features"))
def coalesce_suffixes(spark, sf):
    f = fx.features(spark, sf)
    d = f.select("subject_id", F.col("subject_id").alias("DCSM_ID"), F.col("price_std").alias("Control_x"), F.col("balance").alias("Control_y"), F.col("balance").alias("x_dup"))
    return clean.coalesce_suffixes(d)


@query("exclude_sessions", with_views("features", "night", "lights", body="""
SELECT subject_id, balance FROM features WHERE subject_id NOT IN
 (SELECT 'C' || substr(session_id, 2) FROM lights WHERE lights_off > 2 * 86400 UNION SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'P')"""))
def exclude_sessions(spark, sf):
    return cohort.exclude(fx.features(spark, sf).select("subject_id", "balance"), bad_ids(spark, sf), "subject_id")[0]


def bad_ids(spark, sf):
    """Ids with late lights-off and ids listed by hand (customers with partial orders)."""
    late = fx.lights(spark, sf).filter(F.col("lights_off") > 2 * DAY).select(F.concat(F.lit("C"), F.substring(KEY, 2, 20)).alias("subject_id"))
    hand = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("C"), "o_custkey").alias("subject_id"))
    return late.union(hand).distinct()


BAD = """bad AS (SELECT 'C' || substr(session_id, 2) AS subject_id FROM lights WHERE lights_off > 2 * 86400 UNION SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'P')"""


@query("id_union_distinct", with_views("lights", body=f", {BAD} SELECT * FROM bad"))
def id_union_distinct(spark, sf):
    return bad_ids(spark, sf)


@query("id_except", with_views("lights", "features", body=f", {BAD} SELECT subject_id FROM bad EXCEPT SELECT subject_id FROM features WHERE balance > 0"))
def id_except(spark, sf):
    return cohort.exclude(fx.features(spark, sf).filter("balance > 0"), bad_ids(spark, sf), "subject_id")[1]


@query("numeric_feature_cols", with_views("features", body=f"SELECT subject_id, {', '.join(FEATURES)} FROM features"))
def numeric_feature_cols(spark, sf):
    f = fx.features(spark, sf)
    return f.select("subject_id", *clean.numeric_feature_cols(f, ["subject_id"]))


@query("feature_subset", with_views("features", body='SELECT subject_id, price_mean AS waso_min, balance AS "eeg__w__delta", price_std AS n_rem_cycles FROM features'))
def feature_subset(spark, sf):
    f = fx.features(spark, sf).select("subject_id", F.col("price_std").alias("n_rem_cycles"), F.col("balance").alias("eeg__w__delta"), F.col("price_mean").alias("waso_min"), "price_max")
    return clean.select_present(f, ["subject_id"], [*cohort.SPECTRAL_BASELINE, *cohort.MACRO_BASELINE])[0]


@query("parse_class", """
SELECT o_orderkey, CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'int' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind, try_cast(v AS DOUBLE) AS num,
  CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END AS txt
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(o_custkey AS VARCHAR) WHEN 'F' THEN o_custkey || '.5' ELSE o_orderpriority END AS v FROM orders)""")
def parse_class(spark, sf):
    v = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")).when(F.col("o_orderstatus") == "F", F.concat("o_custkey", F.lit(".5"))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", clean.parse_class(v).alias("p")).select("o_orderkey", "p.*")


# ---- report tables ----

LONG = f"long AS (SELECT subject_id, segment_group, feature, value FROM (SELECT * FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)})))"


def long(spark, sf):
    return report.long_features(fx.features(spark, sf), ["subject_id", "segment_group"], FEATURES)


@query("describe_features", with_views("features", body=f""", {LONG}
SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(stddev_pop(value), 4) AS std_pop,
  round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) FILTER (WHERE value IS NULL) AS n_null, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM long GROUP BY 1"""))
def describe_features(spark, sf):
    return report.describe_features(long(spark, sf))


HIST = """
b AS (SELECT feature, min(value) AS lo, max(value) AS hi, CAST(least(20, greatest(5, count(value) // 3)) AS INTEGER) AS nb FROM long WHERE value IS NOT NULL GROUP BY 1 HAVING count(value) >= 2),
h AS (SELECT feature, CAST(coalesce(least(nb - 1, floor((value - lo) / nullif(hi - lo, 0) * nb)), 0) AS INTEGER) AS bin, count(*) AS c FROM long JOIN b USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT feature, lo, hi, nb, CAST(unnest(range(nb)) AS INTEGER) AS bin FROM b)
SELECT g.feature, g.bin, round(lo + (hi - lo) / nb * g.bin, 6) AS "left", round(lo + (hi - lo) / nb * (g.bin + 1), 6) AS "right", coalesce(c, 0) AS count FROM g LEFT JOIN h USING (feature, bin)"""


@query("histogram", with_views("features", body=f", {LONG}, {HIST}"))
def histogram(spark, sf):
    return report.histogram(long(spark, sf)).withColumns({c: F.round(c, 6) for c in ("left", "right")})


def _box_sql(keys: str) -> str:
    return f""", {LONG},
q AS (SELECT {keys}, count(value) AS n, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM long WHERE value IS NOT NULL GROUP BY {keys}),
w AS (SELECT *, greatest(mn, q1 - 1.5 * (q3 - q1)) AS wl, least(mx, q3 + 1.5 * (q3 - q1)) AS wh FROM q)
SELECT {keys}, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, round(any_value(wl), 4) AS whisker_lo, round(any_value(wh), 4) AS whisker_hi,
  count(*) FILTER (WHERE value < wl OR value > wh) AS n_outliers FROM long JOIN w USING ({keys}) GROUP BY {keys}"""


def _round_box(d):
    return d.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


@query("boxplot_stats", with_views("features", body=_box_sql("feature")))
def boxplot_stats(spark, sf):
    return _round_box(report.boxplot_stats(long(spark, sf)))


@query("group_distribution", with_views("features", body=_box_sql("feature, segment_group")))
def group_distribution(spark, sf):
    return _round_box(report.group_distribution(long(spark, sf), "segment_group"))


@query("null_audit", with_views("features", body=f""", {LONG}
SELECT feature, count(*) FILTER (WHERE value IS NULL) AS n_null, round(count(*) FILTER (WHERE value IS NULL) * 100e0 / count(*), 4) AS pct_null FROM long GROUP BY 1"""))
def null_audit(spark, sf):
    return report.null_audit(long(spark, sf))


@query("null_audit_sessions", with_views("features", body=f""", {LONG}
SELECT subject_id, count(*) FILTER (WHERE value IS NULL) AS n_missing, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE value IS NULL), '') AS missing FROM long GROUP BY 1"""))
def null_audit_sessions(spark, sf):
    return report.null_audit_sessions(long(spark, sf))


@query("signal_range", with_views("night", body="""
SELECT session_id, stage, min(LOC) AS "LOC_min", max(LOC) AS "LOC_max", round(avg(LOC), 6) AS "LOC_mean", round(stddev_samp(LOC), 6) AS "LOC_std",
  min(ROC) AS "ROC_min", max(ROC) AS "ROC_max", round(avg(ROC), 6) AS "ROC_mean", round(stddev_samp(ROC), 6) AS "ROC_std" FROM night GROUP BY 1, 2"""))
def signal_range(spark, sf):
    r = clean.signal_range(fx.night(spark, sf), ["LOC", "ROC"], [KEY, "stage"])
    return r.withColumns({f"{c}_{k}": F.round(f"{c}_{k}", 6) for c in ("LOC", "ROC") for k in ("mean", "std")})


@query("to_microvolt", with_views("night", body="SELECT session_id, time_sec, LOC * 1e6 AS LOC, ROC * 1e6 AS ROC FROM night"))
def to_microvolt(spark, sf):
    """Channels read as volts."""
    return clean.to_microvolt(fx.night(spark, sf).select(KEY, T, "LOC", "ROC"))


# ---- importance and rankings ----

RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY run_tag ORDER BY importance DESC) AS rank FROM importance)"
STAB = f"""{RANKED}, st AS (SELECT feature, count(*) AS n_runs, avg(rank) AS mean_rank, stddev_samp(rank) AS std_rank, min(rank) AS min_rank, max(rank) AS max_rank,
  avg(importance) AS mean_importance, stddev_samp(importance) AS std_importance, count(*) FILTER (WHERE rank <= 10) AS times_top_k, median(rank) AS median_rank,
  count(*) FILTER (WHERE rank <= 10) / (SELECT count(DISTINCT run_tag) FROM rk) AS frac_top_k FROM rk GROUP BY 1)"""
STAB_COLS = """feature, n_runs, round(mean_rank, 6) AS mean_rank, round(std_rank, 6) AS std_rank, min_rank, max_rank, round(mean_importance, 2) AS mean_importance,
  round(std_importance, 2) AS std_importance, times_top_k, median_rank, round(frac_top_k, 6) AS frac_top_k"""


def stability(spark, sf):
    s = report.importance_stability(fx.importance(spark, sf), 10)
    return s.withColumns({**{c: F.round(c, 6) for c in ("mean_rank", "std_rank", "frac_top_k")}, **{c: F.round(c, 2) for c in ("mean_importance", "std_importance")}})


@query("rank_min", with_views("importance", body=f", {RANKED} SELECT feature, run_tag, importance, rank FROM rk"))
def rank_min(spark, sf):
    return report.rank_min(fx.importance(spark, sf), "importance", "rank", ["run_tag"])


@query("importance_stability", with_views("importance", body=f", {STAB} SELECT {STAB_COLS} FROM st"))
def importance_stability(spark, sf):
    return stability(spark, sf)


@query("rank_matrix", with_views("importance", body=f"""
, {RANKED} SELECT feature, {', '.join(f"min(rank) FILTER (WHERE run_tag = 'y{y}') AS y{y}" for y in range(1992, 1999))} FROM rk GROUP BY 1"""))
def rank_matrix(spark, sf):
    return report.rank_matrix(fx.importance(spark, sf), [f"y{y}" for y in range(1992, 1999)])


@query("sweep_runs", """
SELECT o_orderkey, o_orderpriority AS mode, o_orderstatus AS best_model, CASE WHEN o_totalprice > 1000 THEN 'ok' ELSE 'failed' END AS status FROM orders
WHERE o_totalprice > 1000 AND o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'""")
def sweep_runs(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("best_model"),
                                          F.when(F.col("o_totalprice") > 1000, "ok").otherwise("failed").alias("status"))
    return report.sweep_runs(s, "2-HIGH", "O")


@query("topk_frequency", with_views("importance", body=f", {STAB} SELECT {STAB_COLS} FROM st WHERE frac_top_k > 0 ORDER BY median_rank, feature LIMIT 8"))
def topk_frequency(spark, sf):
    return report.top_frequency(stability(spark, sf), 8)


YEARS = tuple(f"y{y}" for y in range(1992, 1999))


def effects(spark, sf):
    imp = fx.importance(spark, sf)
    return report.effect_outer({y: imp.filter(F.col("run_tag") == y).withColumnRenamed("importance", "abs_cliffs_delta") for y in YEARS})


EFFECT = f"eff AS (SELECT *, greatest({', '.join(YEARS)}) AS max_effect FROM (SELECT feature, {', '.join(f'''max(importance) FILTER (WHERE run_tag = '{y}') AS {y}''' for y in YEARS)} FROM importance WHERE run_tag IN {YEARS} GROUP BY 1))"


@query("effect_outer", with_views("importance", body=f", {EFFECT} SELECT * FROM eff"))
def effect_outer(spark, sf):
    return effects(spark, sf)


@query("topk_max_effect", with_views("importance", body=f", {EFFECT} SELECT * FROM eff ORDER BY max_effect DESC, feature LIMIT 7"))
def topk_max_effect(spark, sf):
    return report.top_max_effect(effects(spark, sf), 7)


@query("topk_per_group", with_views("importance", body="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_tag ORDER BY importance DESC, feature) AS position FROM importance) WHERE position <= 4"""))
def topk_per_group(spark, sf):
    return report.top_per_group(fx.importance(spark, sf), "run_tag", "importance", 4)


# ---- row-level cleaning on the night ----


@query("trim_lights", with_views("night", "lights", body="""
SELECT n.session_id, n.event_id, n.time_sec FROM night n JOIN lights l USING (session_id) WHERE n.time_sec BETWEEN l.lights_off AND l.lights_on"""))
def trim_lights(spark, sf):
    return clean.trim_lights(fx.night(spark, sf).select(KEY, "event_id", T), fx.lights(spark, sf))


@query("mask_artefacts", with_views("night", body="""
SELECT session_id, event_id, CASE WHEN abs(LOC) <= 300 AND abs(ROC) <= 300 THEN LOC END AS LOC, CASE WHEN abs(LOC) <= 300 AND abs(ROC) <= 300 THEN ROC END AS ROC FROM night"""))
def mask_artefacts(spark, sf):
    return clean.mask_artefacts(fx.night(spark, sf).select(KEY, "event_id", "LOC", "ROC"))


@query("artefact_report", with_views("night", body="""
SELECT session_id, count(*) FILTER (WHERE abs(LOC) > 300 OR abs(ROC) > 300) AS n_masked, count(*) FILTER (WHERE abs(LOC) > 300 OR abs(ROC) > 300) / count(*) AS masked_fraction FROM night GROUP BY 1"""))
def artefact_report(spark, sf):
    return clean.artefact_report(fx.night(spark, sf))


@query("unit_sanity", with_views("indexed", body="""
SELECT session_id, max(abs(LOC)) AS loc_max_abs, max(abs(ROC)) AS roc_max_abs, max(abs(LOC)) BETWEEN 1 AND 250 AND max(abs(ROC)) BETWEEN 1 AND 250 AS usable FROM indexed GROUP BY 1"""))
def unit_sanity(spark, sf):
    return clean.unit_sanity(fx.indexed(spark, sf), hi=250.0)


_CODE = "CASE s WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'REM' THEN 4 ELSE 0 END"


@query("stage_encode", with_views("night", body=f"""
SELECT session_id, event_id, {_CODE} AS code, CASE {_CODE} WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' WHEN 4 THEN 'REM' END AS decoded
FROM (SELECT session_id, event_id, CASE WHEN k > 90 THEN 'unknown' ELSE stage END AS s FROM night)"""))
def stage_encode(spark, sf):
    n = fx.night(spark, sf).select(KEY, "event_id", F.when(F.col("k") > 90, "unknown").otherwise(F.col("stage")).alias("s"))
    return n.select(KEY, "event_id", clean.stage_encode(F.col("s")).alias("code")).withColumn("decoded", clean.stage_decode(F.col("code")))


@query("stage_normalise", with_views("night", body="SELECT session_id, event_id, upper(trim('  ' || lower(stage) || ' ')) AS stage FROM night"))
def stage_normalise(spark, sf):
    return fx.night(spark, sf).select(KEY, "event_id", clean.stage_normalise(F.concat(F.lit("  "), F.lower("stage"), F.lit(" "))).alias("stage"))


@query("event_artefact_filter", with_views("rem_events", body='SELECT session_id, event_id, Start, "End" FROM rem_events WHERE LOCAbsValPeak <= 100 AND ROCAbsValPeak <= 100'))
def event_artefact_filter(spark, sf):
    return clean.drop_artefact_events(fx.rem_events(spark, sf), 100.0).select(KEY, "event_id", "Start", "End")


@query("artefact_event_report", with_views("rem_events", body="""
SELECT session_id, count(*) AS n_events, count(*) FILTER (WHERE LOCAbsValPeak > 100 OR ROCAbsValPeak > 100) AS n_removed,
  count(*) FILTER (WHERE LOCAbsValPeak > 100 OR ROCAbsValPeak > 100) / count(*) AS removed_fraction FROM rem_events GROUP BY 1"""))
def artefact_event_report(spark, sf):
    return clean.artefact_event_report(fx.rem_events(spark, sf), 100.0)


@query("time_offset", with_views("rem_events", "lights", body="""
SELECT r.session_id, event_id, Start + lights_off AS Start, Peak + lights_off AS Peak, "End" + lights_off AS "End" FROM rem_events r JOIN lights USING (session_id)"""))
def time_offset(spark, sf):
    e = fx.rem_events(spark, sf).select(KEY, "event_id", "Start", "Peak", "End")
    return clean.time_offset(e, fx.lights(spark, sf), ["Start", "Peak", "End"])


@query("rem_filter", with_views("merged", body="SELECT session_id, time_sec, EpochType FROM merged WHERE stage = 'REM' AND EpochType = 'Phasic'"))
def rem_filter(spark, sf):
    return fx.merged_table(spark, sf).filter((F.col("stage") == "REM") & (F.col("EpochType") == "Phasic")).select(KEY, T, "EpochType")


@query("pruned_scan", with_views("merged", body="SELECT session_id, time_sec, stage FROM merged"))
def pruned_scan(spark, sf):
    m = require(fx.merged_table(spark, sf), [KEY, T, "stage"])
    return clean.select_present(m, [], [KEY, T, "stage", "Start_x"])[0]


CH = """ch AS (SELECT 'H' || o_custkey AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ch_idx,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'EOG L' WHEN '2-HIGH' THEN 'eogh' WHEN '3-MEDIUM' THEN 'EOG ' || (o_orderkey % 7) WHEN '4-NOT SPECIFIED' THEN 'loc' ELSE 'E1-M2' END AS ch_name FROM orders)"""


def channels(spark, sf):
    """Channel headers: the orders of a customer as its channels."""
    p = F.col("o_orderpriority")
    o = table(spark, sf, "orders")
    name = (F.when(p == "1-URGENT", "EOG L").when(p == "2-HIGH", "eogh").when(p == "3-MEDIUM", F.concat(F.lit("EOG "), F.col("o_orderkey") % 7))
            .when(p == "4-NOT SPECIFIED", "loc").otherwise("E1-M2"))
    return o.select(F.concat(F.lit("H"), "o_custkey").alias(KEY), F.col("o_orderkey").alias("ch_idx"), name.alias("ch_name"))


@query("channel_rename", f"""
WITH {CH}, e AS (SELECT *, upper(trim(ch_name)) AS u, replace(upper(trim(ch_name)), 'EOG', '') AS rest FROM ch),
x AS (SELECT session_id, bool_or(u = 'LOC') AS hl, bool_or(u = 'ROC') AS hr, count(*) FILTER (WHERE u LIKE '%EOG%') AS n,
  arg_min(ch_name, ch_idx) FILTER (WHERE u LIKE '%EOG%' AND regexp_matches(rest, '[LV]') AND NOT regexp_matches(rest, '[RH]')) AS l,
  arg_min(ch_name, ch_idx) FILTER (WHERE u LIKE '%EOG%' AND regexp_matches(rest, '[RH]') AND NOT regexp_matches(rest, '[LV]')) AS r,
  arg_min(ch_name, ch_idx) FILTER (WHERE u LIKE '%EOG%') AS e1, arg_max(ch_name, ch_idx) FILTER (WHERE u LIKE '%EOG%') AS e2 FROM e GROUP BY 1)
SELECT session_id, CASE WHEN hl THEN NULL WHEN l IS NOT NULL THEN l WHEN n = 2 AND r IS NULL THEN e1 WHEN n = 2 THEN CASE WHEN e1 <> r THEN e1 WHEN e2 <> r THEN e2 END END AS loc_source,
  CASE WHEN hr THEN NULL WHEN r IS NOT NULL THEN r WHEN n = 2 AND l IS NULL THEN e2 WHEN n = 2 THEN CASE WHEN e1 <> l THEN e1 WHEN e2 <> l THEN e2 END END AS roc_source FROM x""")
def channel_rename(spark, sf):
    return clean.channel_rename(channels(spark, sf))


@query("channel_names", f"WITH {CH} SELECT DISTINCT ch_name FROM ch WHERE regexp_matches(upper(ch_name), 'EOG|LOC|ROC|E1|E2')")
def channel_names(spark, sf):
    return clean.channel_names(channels(spark, sf))


