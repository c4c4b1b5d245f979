"""The driver tables seen as nights, cohorts and model outputs.

Each view exists twice: as a DataFrame function and as a SQL text (``SQL``) for the
check engine.  All rows of the source tables are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleepsignal.operators import align, clean, events, runs
from sleepsignal.plans.chunked import CHUNK, row_index, with_time_chunk
from sleepsignal.schemas import KEY, T
from sleepsignal.session import cut

# The sparse night: about two samples a day, so lengths are hours, not seconds.
DAY = 86400.0
CHUNK_S = 5 * DAY
EPOCH_S = 43200.0
SUB_S = 14400.0
PHASIC_S = 9000.0
FS = 0.25
# The dense night: a regular grid.
DENSE_FS = 16.0
ORIGIN_US = 1704067200000000

SQL: dict[str, str] = {}
_STAGES: dict[tuple[str, str], DataFrame] = {}


def with_views(*names: str, body: str) -> str:
    """SQL text with the named views (and what they need) in front."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS.get(n, ()):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body


NEEDS: dict[str, tuple[str, ...]] = {
    "staging": ("night",),
    "rem_events": ("night",),
    "em_events": ("night",),
    "eeg": ("night",),
    "lights": ("night",),
    "indexed": ("night",),
    "hypno": ("staging",),
    "subepochs": ("night", "hypno", "em_events"),
    "merged": ("night", "staging", "rem_events", "em_events", "subepochs", "eeg"),
    "dense_night": ("dense",),
    "long_features": ("features",),
    "splits": ("long_features",),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def choose(key: Column, pairs: dict[str, str]) -> Column:
    items = list(pairs.items())
    first = F.when(key == items[0][0], items[0][1])
    return reduce(lambda c, p: c.when(key == p[0], p[1]), items[1:], first)


def sql_choose(key: str, pairs: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {key}='{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


STAGE_OF_EVENT = {"click": "W", "error": "N1", "purchase": "N2", "signup": "N3", "view": "REM"}
STAGE_OF_LINE = {"AF": "W", "AO": "N1", "NF": "N2", "NO": "REM", "RF": "N3", "RO": "REM"}
GROUP_OF_SEGMENT = {
    "BUILDING": "Control", "AUTOMOBILE": "iRBD", "MACHINERY": "PD(+RBD)", "FURNITURE": "PD(-RBD)", "HOUSEHOLD": "PLM",
}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, in any session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86_400_000_000)
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days + secs.cast("long") * F.lit(1_000_000) + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def night(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id")).alias(KEY), "event_id",
        ((micros("ts") - F.lit(ORIGIN_US)) / F.lit(1e6)).alias(T),
        choose(F.col("event_type"), STAGE_OF_EVENT).alias("stage"), k.alias("k"),
        (F.col("value") + k / F.lit(7919.0)).alias("LOC"), (-F.col("value") * k / F.lit(107.0)).alias("ROC"),
    )


SQL["night"] = f"""
SELECT 'S' || user_id AS session_id, event_id, (epoch_us(ts) - {ORIGIN_US}) / 1e6 AS time_sec,
       {sql_choose('event_type', STAGE_OF_EVENT)} AS stage,
       CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, value + CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) / 7919e0 AS LOC,
       -value * CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) / 107e0 AS ROC
FROM events"""


def eog(spark: SparkSession, sf: str) -> DataFrame:
    return night(spark, sf).select(KEY, T, "LOC", "ROC")


def staging(spark: SparkSession, sf: str) -> DataFrame:
    """Half-day epochs: stage of the first sample, probabilities as shares of the samples."""
    e = F.floor(F.col(T) / EPOCH_S).cast("long")
    share = lambda s: F.avg(F.when(F.col("stage") == s, 1.0).otherwise(0.0))
    return (
        night(spark, sf).groupBy(KEY, e.alias("_e"))
        .agg(F.min_by("stage", T).alias("stage"), *[share(s.upper() if s != "rem" else "REM").alias(f"prob_{s}") for s in ("w", "n1", "n2", "n3", "rem")])
        .select(KEY, (F.col("_e") * EPOCH_S).alias("epoch_start"), "stage", "prob_w", "prob_n1", "prob_n2", "prob_n3", "prob_rem")
    )


SQL["staging"] = f"""
SELECT session_id, e * {EPOCH_S}e0 AS epoch_start, arg_min(stage, time_sec) AS stage,
       {', '.join(f"avg(CASE WHEN stage='{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prob_{s.lower()}" for s in ('W', 'N1', 'N2', 'N3', 'REM'))}
FROM (SELECT *, CAST(floor(time_sec / {EPOCH_S}) AS BIGINT) AS e FROM night) GROUP BY session_id, e"""


def hypno(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch index and stage code of the staging table."""
    return staging(spark, sf).select(
        KEY, F.floor(F.col("epoch_start") / EPOCH_S).cast("long").alias("epoch_idx"), clean.stage_encode(F.col("stage")).alias("stage_code")
    )


SQL["hypno"] = f"""
SELECT session_id, CAST(floor(epoch_start / {EPOCH_S}) AS BIGINT) AS epoch_idx,
       CASE stage WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'REM' THEN 4 ELSE 0 END AS stage_code
FROM staging"""


def _events(spark: SparkSession, sf: str, shift: str, scale: float) -> DataFrame:
    n = night(spark, sf)
    start = F.col(T) + F.expr(shift)
    dur = F.col("LOC") * scale
    return n.select(
        KEY, "event_id", start.alias("Start"), (start + dur / 2).alias("Peak"), (start + dur).alias("End"), dur.alias("Duration"),
        F.col("LOC").alias("LOCAbsValPeak"), F.abs("ROC").alias("ROCAbsValPeak"),
        (F.col("LOC") / (F.col("k") + 1)).alias("LOCAbsRiseSlope"), (F.col("LOC") / (F.col("k") + 2)).alias("ROCAbsRiseSlope"),
        (F.col("LOC") / (F.col("k") + 3)).alias("LOCAbsFallSlope"), (F.col("LOC") / (F.col("k") + 4)).alias("ROCAbsFallSlope"),
        F.col("stage").alias("Stage"),
    )


def _sql_events(shift: str, scale: float) -> str:
    return f"""
SELECT session_id, event_id, time_sec + {shift} AS Start, time_sec + {shift} + LOC * {scale} / 2 AS Peak,
       time_sec + {shift} + LOC * {scale} AS "End", LOC * {scale} AS Duration, LOC AS LOCAbsValPeak, abs(ROC) AS ROCAbsValPeak,
       LOC / (k + 1) AS LOCAbsRiseSlope, LOC / (k + 2) AS ROCAbsRiseSlope, LOC / (k + 3) AS LOCAbsFallSlope,
       LOC / (k + 4) AS ROCAbsFallSlope, stage AS Stage"""


def rem_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, "k * 37", 600.0)


def em_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf, "1800", 300.0)
    return e.withColumns({
        "MeanAbsValPeak": (F.col("LOCAbsValPeak") + F.col("ROCAbsValPeak")) / 2, "EM_Type": clean.em_type(F.col("Duration"), 9000.0),
    })


SQL["rem_events"] = _sql_events("k * 37", 600.0) + " FROM night"
SQL["em_events"] = _sql_events("1800", 300.0) + """,
       (LOC + abs(ROC)) / 2 AS MeanAbsValPeak, CASE WHEN LOC * 300.0 > 9000.0 THEN 'SEM' ELSE 'REM' END AS EM_Type FROM night"""


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return night(spark, sf).groupBy(KEY).agg(F.max(T).alias("duration_s"))


def subepochs(spark: SparkSession, sf: str) -> DataFrame:
    return events.classify_subepochs(hypno(spark, sf), durations(spark, sf), em_events(spark, sf), EPOCH_S, SUB_S, PHASIC_S)


SQL["subepochs"] = f"""
SELECT g.session_id, g.s AS SubEpochStart, g.s + {SUB_S}e0 AS SubEpochEnd, CAST(g.epoch_idx AS INTEGER) AS EpochIdx,
       CASE WHEN coalesce(sum(e.Duration), 0) >= {PHASIC_S} THEN 'Phasic' ELSE 'Tonic' END AS EpochType
FROM (SELECT h.session_id, h.epoch_idx, h.epoch_idx * {EPOCH_S}e0 + r.range * {SUB_S}e0 AS s
      FROM hypno h, range(CAST({EPOCH_S} / {SUB_S} AS BIGINT)) r WHERE h.stage_code = 4) g
JOIN (SELECT session_id, max(time_sec) AS dur FROM night GROUP BY 1) d ON d.session_id = g.session_id AND g.s + {SUB_S} <= d.dur
LEFT JOIN em_events e ON e.session_id = g.session_id AND e.Peak >= g.s AND e.Peak < g.s + {SUB_S}
GROUP BY g.session_id, g.s, g.epoch_idx"""


def eeg(spark: SparkSession, sf: str) -> DataFrame:
    return night(spark, sf).select(
        KEY, (F.col(T) + F.col("k") % 7 * 2000).alias(T), (F.col("LOC") - 50).alias("EEG_LOC"), (F.col("k") - 50.0).alias("EEG_ROC")
    )


SQL["eeg"] = "SELECT session_id, time_sec + k % 7 * 2000 AS time_sec, LOC - 50 AS EEG_LOC, k - 50.0::DOUBLE AS EEG_ROC FROM night"


def lights(spark: SparkSession, sf: str) -> DataFrame:
    """Lights off / on from the first and last sample: one day after, one day before."""
    return night(spark, sf).groupBy(KEY).agg((F.min(T) + DAY).alias("lights_off"), (F.max(T) - DAY).alias("lights_on"))


SQL["lights"] = f"SELECT session_id, min(time_sec) + {DAY} AS lights_off, max(time_sec) - {DAY} AS lights_on FROM night GROUP BY 1"


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return align.merged_timeline(
        eog(spark, sf), staging(spark, sf), rem_events(spark, sf), em_events(spark, sf), subepochs(spark, sf), eeg(spark, sf), CHUNK_S
    )


_EV = ["event_id", "Peak", '"End"', "Duration", "LOCAbsValPeak", "ROCAbsValPeak", "LOCAbsRiseSlope", "ROCAbsRiseSlope", "LOCAbsFallSlope", "ROCAbsFallSlope", "Stage"]


def _masked(alias: str, prefix: str, cols: list[str]) -> str:
    inside = f'n.time_sec <= {alias}."End"'
    return ",\n  ".join(
        f"CASE WHEN {inside} THEN {alias}.{c} END AS {prefix}{c.strip(chr(34))}" for c in ["Start", *cols]
    )


def _sql_peak(view: str) -> str:
    """Sessions and times of the samples nearest to a peak of the view."""
    return f"""
  SELECT p.session_id, CASE WHEN a.time_sec IS NULL THEN b.time_sec WHEN b.time_sec IS NULL THEN a.time_sec
         WHEN p.Peak - b.time_sec <= a.time_sec - p.Peak THEN b.time_sec ELSE a.time_sec END AS time_sec
  FROM {view} p ASOF LEFT JOIN night b ON p.session_id = b.session_id AND p.Peak >= b.time_sec
       ASOF LEFT JOIN night a ON p.session_id = a.session_id AND p.Peak <= a.time_sec"""


def merged_table(spark: SparkSession, sf: str) -> DataFrame:
    """The merged timeline as a stage table, written once per application and table set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STAGES:
        _STAGES[key] = cut(merged(spark, sf))
    return _STAGES[key]


SQL["merged"] = f"""
SELECT n.session_id, n.time_sec, n.LOC, n.ROC, s.epoch_start, s.stage, s.prob_w, s.prob_n1, s.prob_n2, s.prob_n3, s.prob_rem,
  coalesce(n.time_sec <= r."End", false) AS is_rem_event,
  {_masked('r', 'event_', _EV)},
  (n.session_id, n.time_sec) IN (SELECT (session_id, time_sec) FROM ({_sql_peak('rem_events')})) AS event_is_peak,
  coalesce(n.time_sec <= e."End", false) AS is_em_event,
  {_masked('e', 'em_', [*_EV, 'MeanAbsValPeak'])},
  (n.session_id, n.time_sec) IN (SELECT (session_id, time_sec) FROM ({_sql_peak('em_events')})) AS em_is_peak,
  CASE WHEN n.time_sec <= e."End" THEN e.EM_Type END AS EM_Type,
  CASE WHEN n.time_sec < u.SubEpochEnd THEN u.EpochType END AS EpochType,
  CASE WHEN ga.time_sec IS NULL OR n.time_sec - gb.time_sec <= ga.time_sec - n.time_sec THEN gb.EEG_LOC ELSE ga.EEG_LOC END AS EEG_LOC,
  CASE WHEN ga.time_sec IS NULL OR n.time_sec - gb.time_sec <= ga.time_sec - n.time_sec THEN gb.EEG_ROC ELSE ga.EEG_ROC END AS EEG_ROC
FROM night n
ASOF LEFT JOIN staging s ON n.session_id = s.session_id AND n.time_sec >= s.epoch_start
ASOF LEFT JOIN rem_events r ON n.session_id = r.session_id AND n.time_sec >= r.Start
ASOF LEFT JOIN em_events e ON n.session_id = e.session_id AND n.time_sec >= e.Start
ASOF LEFT JOIN subepochs u ON n.session_id = u.session_id AND n.time_sec >= u.SubEpochStart
ASOF LEFT JOIN eeg gb ON n.session_id = gb.session_id AND n.time_sec >= gb.time_sec
ASOF LEFT JOIN eeg ga ON n.session_id = ga.session_id AND n.time_sec <= ga.time_sec"""


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The night with a sample index; artefacts masked, so there are NULLs."""
    n = row_index(with_time_chunk(night(spark, sf), T, CHUNK_S), [KEY], [T], "sample_idx").drop(CHUNK)
    return clean.mask_artefacts(n)


SQL["indexed"] = """
SELECT * REPLACE (CASE WHEN abs(LOC) <= 300 AND abs(ROC) <= 300 THEN LOC END AS LOC, CASE WHEN abs(LOC) <= 300 AND abs(ROC) <= 300 THEN ROC END AS ROC),
       row_number() OVER (PARTITION BY session_id ORDER BY time_sec) - 1 AS sample_idx FROM night"""


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines of a supplier as a regular 16 Hz signal."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("D"), F.col("l_suppkey")).alias(KEY), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        choose(F.concat("l_returnflag", "l_linestatus"), STAGE_OF_LINE).alias("stage"),
        (F.col("l_quantity") * 10 - 250).alias("LOC"), F.col("l_discount").alias("_d"), "l_tax",
    )
    li = row_index(with_time_chunk(li, "l_orderkey", 8192), [KEY], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "sample_idx")
    li = li.withColumn("ROC", -F.col("LOC") * (F.lit(0.5) + F.col("_d") * 5) + F.col("l_tax") * 100)
    anti = F.col("LOC") * F.col("ROC") < 0
    return li.select(
        KEY, "sample_idx", (F.col("sample_idx") / F.lit(DENSE_FS)).alias(T), "stage", "LOC", "ROC",
        F.when(anti, F.col("LOC") * 0.8).otherwise(0.0).alias("loc_clean"), F.when(anti, F.col("ROC") * 0.8).otherwise(0.0).alias("roc_clean"),
        F.when(F.col("LOC") != 0, F.col("LOC") - F.col("ROC") * 0.1).alias("EEG_LOC"),
        F.when(F.col("l_tax") > 0, F.col("ROC") * 0.5 + 1).alias("EEG_ROC"),
        F.when(F.col("l_tax") < 0.03, "Phasic").when(F.col("l_tax") < 0.06, "Tonic").alias("EpochType"),
    )


def dense_table(spark: SparkSession, sf: str) -> DataFrame:
    """The dense grid as a stage table, written once per application and table set: thresholds and samples both read it."""
    key = (spark.sparkContext.applicationId, f"dense {sf}")
    if key not in _STAGES:
        _STAGES[key] = cut(dense(spark, sf))
    return _STAGES[key]


SQL["dense"] = f"""
SELECT session_id, sample_idx, sample_idx / {DENSE_FS} AS time_sec, stage, LOC, ROC,
  CASE WHEN LOC * ROC < 0 THEN LOC * 0.8 ELSE 0.0 END AS loc_clean, CASE WHEN LOC * ROC < 0 THEN ROC * 0.8 ELSE 0.0 END AS roc_clean,
  CASE WHEN LOC <> 0 THEN LOC - ROC * 0.1 END AS EEG_LOC, CASE WHEN l_tax > 0 THEN ROC * 0.5 + 1 END AS EEG_ROC,
  CASE WHEN l_tax < 0.03::DOUBLE THEN 'Phasic' WHEN l_tax < 0.06::DOUBLE THEN 'Tonic' END AS EpochType
FROM (SELECT *, -LOC * (0.5::DOUBLE + l_discount * 5) + l_tax * 100 AS ROC FROM
 (SELECT 'D' || l_suppkey AS session_id, l_discount, l_tax, {sql_choose('l_returnflag || l_linestatus', STAGE_OF_LINE)} AS stage,
   l_quantity * 10 - 250 AS LOC, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_idx FROM lineitem))"""


#: Columns of a merged night on the dense grid: texts that both engines read alike.
_EM, _EV_ID = "floor(sample_idx / 24e0)", "floor(sample_idx / 40e0)"
DENSE_COLS = {
    "prob_w": "sample_idx % 7 / 10e0", "prob_n1": "sample_idx % 3 / 10e0", "prob_n2": "sample_idx % 11 / 20e0",
    "prob_n3": "CASE WHEN sample_idx % 5 <> 0 THEN 0.05e0 END", "prob_rem": "sample_idx % 13 / 13e0",
    "is_rem_event": "sample_idx % 40 < 12",
    **{f"event_{c}": f"CASE WHEN sample_idx % 40 < 12 THEN {v} END" for c, v in {
        "Start": f"{_EV_ID} * 2.5e0", "Peak": f"{_EV_ID} * 2.5e0 + 0.25e0", "Duration": f"0.5e0 + {_EV_ID} % 5 / 10e0", "LOCAbsValPeak": f"20e0 + {_EV_ID} % 17",
        "ROCAbsValPeak": f"30e0 + {_EV_ID} % 13", "LOCAbsRiseSlope": f"1e0 + {_EV_ID} % 3 / 7e0", "ROCAbsRiseSlope": f"2e0 + {_EV_ID} % 4 / 7e0"}.items()},
    "is_em_event": "sample_idx % 24 < 10",
    **{f"em_{c}": f"CASE WHEN sample_idx % 24 < 10 THEN {v} END" for c, v in {
        "event_id": f"CAST({_EM} AS BIGINT)", "Duration": f"0.2e0 + {_EM} % 7 / 10e0", "MeanAbsValPeak": f"25e0 + {_EM} % 19", "LOCAbsRiseSlope": f"1e0 + {_EM} % 5 / 9e0",
        "ROCAbsRiseSlope": f"2e0 + {_EM} % 6 / 9e0", "LOCAbsFallSlope": f"3e0 + {_EM} % 7 / 9e0", "ROCAbsFallSlope": f"4e0 + {_EM} % 8 / 9e0"}.items()},
    "EM_Type": f"CASE WHEN sample_idx % 24 < 10 THEN CASE WHEN {_EM} % 7 > 3 THEN 'SEM' ELSE 'REM' END END",
}


def dense_night(spark: SparkSession, sf: str) -> DataFrame:
    """A merged timeline on the dense grid: all columns that features are made from."""
    return dense_table(spark, sf).selectExpr(
        KEY, T, "sample_idx", "stage", "LOC", "ROC", "EEG_LOC", "EEG_ROC", "EpochType", *[f"{v} AS {c}" for c, v in DENSE_COLS.items()])


SQL["dense_night"] = f"""
SELECT session_id, time_sec, sample_idx, stage, LOC, ROC, EEG_LOC, EEG_ROC, EpochType, {', '.join(f"{v} AS {c}" for c, v in DENSE_COLS.items())} FROM dense"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer: order and line features, NULL for customers without orders."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("lines"), F.sum("l_discount").alias("disc")
    )
    per = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("order_count"), F.round(F.avg("o_totalprice") * 1.0123456789, 7).alias("price_mean"),
        F.round(F.stddev_samp("o_totalprice"), 7).alias("price_std"), F.max("o_totalprice").alias("price_max"),
        F.round(F.sum("q") / F.sum("lines") * 0.987654321, 9).alias("quantity_mean"), F.round(F.sum("disc") / F.sum("lines") * 1.01234567893, 11).alias("discount_mean"),
    )
    c = table(spark, sf, "customer")
    return c.join(per, "c_custkey", "left").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("subject_id"), choose(F.col("c_mktsegment"), GROUP_OF_SEGMENT).alias("segment_group"),
        F.col("c_acctbal").alias("balance"), "order_count", "price_mean", "price_std", "price_max", "quantity_mean", "discount_mean",
    )


FEATURES = ("balance", "order_count", "price_mean", "price_std", "price_max", "quantity_mean", "discount_mean")

SQL["features"] = f"""
SELECT 'C' || c_custkey AS subject_id, {sql_choose('c_mktsegment', GROUP_OF_SEGMENT)} AS segment_group, c_acctbal AS balance,
  order_count, price_mean, price_std, price_max, quantity_mean, discount_mean
FROM customer LEFT JOIN (
  SELECT o_custkey, CAST(count(*) AS DOUBLE) AS order_count, round(avg(o_totalprice) * 1.0123456789e0, 7) AS price_mean,
    round(stddev_samp(o_totalprice), 7) AS price_std, max(o_totalprice) AS price_max, round(sum(q) / sum(lines) * 0.987654321e0, 9) AS quantity_mean,
    round(sum(disc) / sum(lines) * 1.01234567893e0, 11) AS discount_mean
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS lines, sum(l_discount) AS disc FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey GROUP BY 1) ON c_custkey = o_custkey"""


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """Two scores per labelled document, with ties on purpose."""
    d = table(spark, sf, "documents")
    return table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y_true"), F.col("n_chars").cast("double").alias("score_a"),
        (F.col("doc_id") * 7919 % 1000).cast("double").alias("score_b"),
    )


SQL["oof"] = """
SELECT doc_id AS id, quality AS y_true, CAST(n_chars AS DOUBLE) AS score_a, CAST(doc_id * 7919 % 1000 AS DOUBLE) AS score_b
FROM labels JOIN documents USING (doc_id)"""


def importance(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of a brand per ship year as the importance of a feature in a run."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("feature"), F.concat(F.lit("y"), F.year("l_shipdate")).alias("run_tag"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("importance"))
    )


SQL["importance"] = """
SELECT p_brand AS feature, 'y' || year(l_shipdate) AS run_tag, round(sum(l_extendedprice), 2) AS importance
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
