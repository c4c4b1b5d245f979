"""Inventories, lights files, feature tables, streaming and the whole-night pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleepsignal import schemas
from sleepsignal.catalog import fixtures as fx
from sleepsignal.catalog.cohorts import modules
from sleepsignal.catalog.fixtures import CHUNK_S, DENSE_FS, FS, SUB_S, table, with_views
from sleepsignal.catalog.nights import BANDS, CTX, DCHUNK, MIN_S, SEG_S, TAPS
from sleepsignal.catalog.registry import ORACLE, query
from sleepsignal.catalog.sequences import _SLOPES, DENSE
from sleepsignal.operators import clean, cohort
from sleepsignal.operators.features import eog, fused
from sleepsignal.plans import night
from sleepsignal.schemas import KEY
from sleepsignal.session import run_folder
from sleepsignal.sources import incremental, listing, quarantine, tables
from sleepsignal.streaming.ingest import ingest, session_stream


def files(spark, sf):
    """Raw files: every order is a file in a customer's session folder."""
    o = table(spark, sf, "orders")
    letter = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "contiguous.edf").when(p == "2-HIGH", "hypnogram.csv").when(p == "3-MEDIUM", "lights.txt").when(p == "4-NOT SPECIFIED", "night/contiguous.edf").otherwise("notes.md")
    return o.select(F.concat(F.lit("/raw/DCSM_"), "o_custkey", F.lit("_"), letter, F.lit("/"), name).alias("path"), F.col("o_totalprice").cast("long").alias("length"))


FILES = """fl AS (SELECT 'DCSM_' || o_custkey || '_' || substr('abcd', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS folder, o_custkey, substr('abcd', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS letter,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'contiguous.edf' WHEN '2-HIGH' THEN 'hypnogram.csv' WHEN '3-MEDIUM' THEN 'lights.txt' WHEN '4-NOT SPECIFIED' THEN 'night/contiguous.edf' ELSE 'notes.md' END AS name FROM orders)"""


def _index_sql(recursive: bool) -> str:
    edf = "name IN ('contiguous.edf', 'night/contiguous.edf')" if recursive else "name = 'contiguous.edf'"
    return f"""WITH {FILES}, ix AS (SELECT folder AS patient_id, CAST(o_custkey AS INTEGER) AS patient_number, letter AS session_type,
  min('/raw/' || folder || '/' || name) FILTER (WHERE {edf}) AS edf_path, min('/raw/' || folder || '/' || name) FILTER (WHERE name = 'lights.txt') AS txt_path
FROM fl WHERE letter <> 'd' GROUP BY ALL)"""


@query("session_index", _index_sql(False) + " SELECT * FROM ix WHERE edf_path IS NOT NULL AND txt_path IS NOT NULL")
def session_index(spark, sf):
    return listing.session_index(files(spark, sf), ("edf", "txt"))


@query("session_index_sorted", _index_sql(True) + " SELECT *, '/out/' || patient_id AS out_dir FROM ix WHERE edf_path IS NOT NULL AND txt_path IS NOT NULL ORDER BY patient_number, session_type")
def session_index_sorted(spark, sf):
    return listing.sorted_index(listing.session_index(files(spark, sf), ("edf", "txt"), recursive=True), "/out/")


def outputs_listing(spark, sf):
    """Stage outputs: every line item is a file; lines without discount are empty files."""
    li = table(spark, sf, "lineitem")
    suffix = F.element_at(F.array(*map(F.lit, ["eog.csv", "gssc.csv", "extracted_rems.csv.gz", "em.csv", "subepochs.csv", "eeg.csv.gz", "merged.csv"])), F.least(F.col("l_linenumber"), F.lit(7)))
    return li.select(F.concat(F.lit("/out/DCSM_"), "l_suppkey", F.lit("_"), F.lower("l_linestatus"), F.lit("_"), suffix).alias("path"), (F.col("l_discount") * 100).cast("long").alias("length"))


OUTS = """ol AS (SELECT 'DCSM_' || l_suppkey || '_' || lower(l_linestatus) AS session_id, ['eog', 'staging', 'rem_events', 'em_events', 'subepochs', 'eeg', 'merged'][least(l_linenumber, 7)] AS stage,
  '/out/DCSM_' || l_suppkey || '_' || lower(l_linestatus) || '_' || ['eog.csv', 'gssc.csv', 'extracted_rems.csv.gz', 'em.csv', 'subepochs.csv', 'eeg.csv.gz', 'merged.csv'][least(l_linenumber, 7)] AS path,
  CAST(trunc(l_discount * 100) AS BIGINT) AS length FROM lineitem)"""


@query("stage_outputs", f"WITH {OUTS} SELECT DISTINCT session_id, stage FROM ol WHERE length > 0")
def stage_outputs(spark, sf):
    return listing.stage_outputs(outputs_listing(spark, sf))


@query("empty_file_check", f"WITH {OUTS} SELECT path FROM ol WHERE length = 0")
def empty_file_check(spark, sf):
    return listing.empty_files(outputs_listing(spark, sf))


@query("missing_stages", f"""WITH {OUTS}, s AS (SELECT DISTINCT session_id AS patient_id FROM ol), o AS (SELECT session_id, stage FROM ol WHERE length > 3)
SELECT patient_id, {', '.join(f"coalesce(bool_or(stage = '{s}'), false) AS {s}" for s in listing.STAGE_SUFFIX)} FROM s LEFT JOIN o ON o.session_id = patient_id GROUP BY 1""")
def missing_stages(spark, sf):
    """Which outputs of more than three bytes every session with any file has."""
    o = outputs_listing(spark, sf)
    sessions = listing.stage_outputs(o.withColumn("length", F.lit(1))).select(F.col(KEY).alias("patient_id")).distinct()
    return listing.missing_stages(sessions, listing.stage_outputs(o.filter("length > 3")))


@query("remerge_inventory", f"""WITH {OUTS} SELECT session_id, session_id || '_eog_merged.csv' AS output FROM (SELECT DISTINCT session_id, stage FROM ol WHERE length > 0
  AND stage IN ('eeg', 'eog', 'staging', 'rem_events', 'em_events')) GROUP BY 1 HAVING count(*) = 5""")
def remerge_inventory(spark, sf):
    return listing.remerge_inventory(listing.stage_outputs(outputs_listing(spark, sf)))


def done(spark, sf):
    """Merged outputs of the customers that placed an order above 300 000."""
    o = table(spark, sf, "orders").filter("o_totalprice > 300000")
    return o.select(F.concat(F.lit("DCSM_"), "o_custkey", F.lit("_a")).alias(KEY), F.lit("merged").alias("stage")).distinct()


PEND = _index_sql(True) + """, td AS (SELECT * FROM ix WHERE edf_path IS NOT NULL AND txt_path IS NOT NULL AND patient_id NOT IN (SELECT 'DCSM_' || o_custkey || '_a' FROM orders WHERE o_totalprice > 300000))"""


@query("pending_inventory", PEND + " SELECT patient_id, patient_number, session_type FROM td")
def pending_inventory(spark, sf):
    s = listing.session_index(files(spark, sf), ("edf", "txt"), recursive=True)
    return listing.pending(s, done(spark, sf)).select("patient_id", "patient_number", "session_type")


@query("pending_batch", PEND + " SELECT patient_id, patient_number, session_type FROM td ORDER BY patient_number, session_type LIMIT 10")
def pending_batch(spark, sf):
    s = listing.session_index(files(spark, sf), ("edf", "txt"), recursive=True)
    return listing.pending(s, done(spark, sf), batch_size=10).select("patient_id", "patient_number", "session_type")


@query("compact_outputs", f"""WITH {OUTS} SELECT count(*) AS files_before, count(*) FILTER (WHERE length > 5) AS files_after, CAST(sum(length) AS BIGINT) AS bytes_before,
  CAST(sum(length) FILTER (WHERE length > 5) AS BIGINT) AS bytes_after, CAST(sum(length) - sum(length) FILTER (WHERE length > 5) AS BIGINT) AS bytes_saved FROM ol""")
def compact_outputs(spark, sf):
    o = outputs_listing(spark, sf)
    return listing.size_report(o, o.filter("length > 5"))


def lights_files(spark, sf):
    """A one-row lights file per order, with varying header, missing and zero values."""
    o = table(spark, sf, "orders")
    v = F.col("o_custkey") % 5
    head = F.when(v == 0, " LIGHTS_ON ,Lights_off").when(v == 4, "off,on").otherwise("Lights_off, Lights_on")
    off = F.when(F.col("o_orderkey") % 6 == 0, "0").when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderkey").cast("string"))
    on = F.when(F.col("o_orderkey") % 9 == 0, "0.0").otherwise((F.col("o_orderkey") + F.col("o_custkey")).cast("string"))
    row = F.when(v == 0, F.concat(on, F.lit(","), off)).otherwise(F.concat(off, F.lit(", "), on))
    return o.select(F.concat(F.lit("/raw/"), "o_orderkey", F.lit("/lights.txt")).alias("path"), F.concat(head, F.lit("\n"), row, F.lit("\n")).alias("text"))


LIGHTS = """lf AS (SELECT '/raw/' || o_orderkey || '/lights.txt' AS path, o_custkey % 5 <> 4 AS has_columns,
  CASE WHEN o_custkey % 5 = 4 THEN NULL WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS lights_off,
  CASE WHEN o_custkey % 5 = 4 THEN NULL WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(o_orderkey + o_custkey AS DOUBLE) END AS lights_on FROM orders)"""


@query("lights_parse", f"WITH {LIGHTS} SELECT path, lights_off, lights_on, (lights_on - lights_off) / 60 AS sleep_min FROM lf WHERE has_columns AND NOT coalesce(lights_off = 0 AND lights_on = 0, false)")
def lights_parse(spark, sf):
    return tables.usable_lights(tables.parse_lights(lights_files(spark, sf)))


@query("lights_qc", f"""WITH {LIGHTS} SELECT * FROM (SELECT path, lights_off, lights_on, CASE WHEN NOT has_columns THEN 'unreadable' WHEN coalesce(lights_off, 0) = 0 AND coalesce(lights_on, 0) = 0 THEN 'both zero'
  WHEN coalesce(lights_off, 0) = 0 THEN 'lights_off is zero' WHEN coalesce(lights_on, 0) = 0 THEN 'lights_on is zero' END AS issue FROM lf) WHERE issue IS NOT NULL""")
def lights_qc(spark, sf):
    return tables.lights_qc(tables.parse_lights(lights_files(spark, sf)))


@query("scan_samples", with_views("night", body="SELECT session_id, time_sec, LOC, ROC FROM night"))
def scan_samples(spark, sf):
    """Samples written as CSV files per part and read back with names from a column."""
    path = run_folder(spark, "samples")
    fx.eog(spark, sf).write.option("header", "true").csv(path, compression="gzip")
    raw = spark.read.schema("session_id string, time_sec double, LOC double, ROC double").option("header", "true").option("pathGlobFilter", "*.csv*").csv(path)
    return tables.nan_to_null(raw)


@query("sink_tables", with_views("night", body="SELECT session_id, stage, count(*) AS n FROM night GROUP BY 1, 2"))
def sink_tables(spark, sf):
    path = run_folder(spark, "night")
    tables.write_table(fx.night(spark, sf).select(KEY, "stage", "event_id"), path, "stage")
    return tables.scan_parquet(spark, path, [KEY, "stage", "no_such_column"]).groupBy(KEY, "stage").agg(F.count(F.lit(1)).alias("n"))


@query("append_union", with_views("features", body="""
SELECT subject_id, balance, NULL AS order_count FROM features WHERE balance > 1000 UNION ALL SELECT subject_id, balance * 2, order_count FROM features WHERE order_count IS NOT NULL"""))
def append_union(spark, sf):
    a, b, _ = modules(spark, sf)
    return incremental.append_union(a, b)


@query("incremental_features", with_views("night", body="""
SELECT session_id, CASE WHEN max(time_sec) < 2550000 THEN -1 ELSE count(*) END AS n FROM night GROUP BY 1"""))
def incremental_features(spark, sf):
    """Sessions that ended early are already in the table (n = -1); the others are extracted and appended."""
    n = fx.night(spark, sf)
    old = n.groupBy(KEY).agg(F.max("time_sec").alias("_t")).filter("_t < 2550000").select(KEY, F.lit(-1).cast("long").alias("n"))
    return incremental.incremental(n, old, lambda d: d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY)


@query("module_tables", with_views("night", body="""
SELECT session_id, count(*) AS n, CASE WHEN max(time_sec) < 2550000 THEN -1 ELSE 0 END + round(sum(LOC), 4) AS total, round(max(ROC), 6) AS top FROM night GROUP BY 1"""))
def module_tables(spark, sf):
    """Three nights of runs: some sessions, then all with one module changed and redone, then nothing new."""
    n = fx.night(spark, sf)
    root = run_folder(spark, "modules")
    early = n.join(n.groupBy(KEY).agg(F.max("time_sec").alias("_t")).filter("_t < 2550000").select(KEY), KEY, "left_semi")
    total = lambda shift: lambda d: d.groupBy(KEY).agg((F.when(F.max("time_sec") < 2550000, shift).otherwise(0) + F.round(F.sum("LOC"), 4)).alias("total"))
    count = lambda d: d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    top = lambda d: d.groupBy(KEY).agg(F.round(F.max("ROC"), 6).alias("top"))
    incremental.update_modules(early, root, {"count": count, "total": total(7)}, KEY)
    for _ in range(2):
        found, failed = incremental.update_modules(n, root, {"count": count, "total": total(-1), "top": top}, KEY, redo=("total",))
    return cohort.outer_merge(list(found.values()), KEY)


@query("incremental_ingest", with_views("night", body="SELECT user_id AS session, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"))
def incremental_ingest(spark, sf):
    """The event file as a stream of session files; the second run finds nothing new."""
    base = run_folder(spark, "ingest")
    schema = table(spark, sf, "events").schema
    per = lambda d: d.groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    for _ in range(2):
        ingest(session_stream(spark, sf, schema, pattern="events.parquet"), per, f"{base}/out", f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("session").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


#: Every third session's file lacks a column, every fifth has rows cut short, every seventh nothing but a header.
FAULT = """CASE WHEN u % 3 = 0 THEN 'missing columns: ROC' WHEN u % 7 = 0 THEN 'no rows' WHEN u % 5 = 0 THEN n || ' rows cut or joined' END"""


@query("ingest_rejects", f"""
SELECT session_id, CASE WHEN reason IS NULL THEN n END AS n, CASE WHEN reason IS NULL THEN round(total, 4) END AS total, reason FROM (
  SELECT 'DCSM_' || u || '_a' AS session_id, n, total, {FAULT} AS reason FROM (SELECT user_id AS u, count(*) AS n, sum(value) AS total FROM events GROUP BY 1))""")
def ingest_rejects(spark, sf):
    """One file per session, some of them bad: the good ones are taken in, the others listed with the reason."""
    base = run_folder(spark, "rejects")
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.col("event_id").cast("string").alias("t"), F.col("value").cast("string").alias("v"))
    short = F.col("u") % 3 == 0
    head = e.select("u").distinct().select("u", F.lit(-1).cast("long").alias("k"), F.when(short, "time_sec,LOC").otherwise("ROC,time_sec,LOC").alias("value"))
    line = F.when(short, F.concat_ws(",", "t", "v")).when(F.col("u") % 5 == 0, F.concat_ws(",", "v", "t")).otherwise(F.concat_ws(",", F.lit("1.5"), "t", "v"))
    rows = e.filter(short | (F.col("u") % 7 != 0)).select("u", F.col("t").cast("long").alias("k"), line.alias("value"))
    lines = head.unionByName(rows).repartition("u").sortWithinPartitions("u", "k")
    lines.select(F.concat(F.lit("DCSM_"), "u", F.lit("_a")).alias("file"), "value").write.partitionBy("file").text(f"{base}/in")
    per = lambda d: d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("LOC"), 4).alias("total"))
    good, bad = quarantine.ingest_folder(spark, f"{base}/in", f"{base}/out", schemas.EOG, per, "*.txt")
    bad = bad.select(F.regexp_extract("path", schemas.SESSION_ID, 1).alias(KEY), "reason")
    return good.unionByName(bad, allowMissingColumns=True)


#: Epochs, sub-epochs and limits that fit the 16 Hz grid.
DETECT = night.Settings(detect_fs=DENSE_FS, epoch_s=2.0, sub_s=0.5, phasic_s=0.25, artefact_uv=150.0)
#: Filtered values have six decimals, so slopes may lie on a rounding border: they are rounded times pi.
SLOPES_AT_PI = _SLOPES.replace("round(abs(", "round(pi() * abs(")
RAW_TO_EVENTS = f"""
taps AS (SELECT unnest(range(41)) - 20 AS o, unnest([{', '.join(repr(float(x)) for x in TAPS)}]) AS w),
flt AS (SELECT a.session_id, a.sample_idx, round(sum(w * b.LOC), 6) AS lc, round(sum(w * b.ROC), 6) AS rc
  FROM dense a, taps JOIN dense b ON b.session_id = a.session_id AND b.sample_idx = a.sample_idx - o GROUP BY 1, 2),
gated AS (SELECT d.* REPLACE (CASE WHEN lc * rc < 0 THEN lc ELSE 0 END AS loc_clean, CASE WHEN lc * rc < 0 THEN rc ELSE 0 END AS roc_clean) FROM dense d JOIN flt USING (session_id, sample_idx)),
{DENSE.strip().replace('FROM dense', 'FROM gated')},
em AS (SELECT ev.session_id, li / {DENSE_FS} AS Start, i / {DENSE_FS} AS Peak, ri / {DENSE_FS} AS "End", ri / {DENSE_FS} - li / {DENSE_FS} AS Duration,
  abs(l) AS LOCAbsValPeak, abs(r) AS ROCAbsValPeak, {SLOPES_AT_PI}, ev.Stage, round((abs(g.LOC) + abs(g.ROC)) / 2, 4) AS MeanAbsValPeak,
  CASE WHEN ri / {DENSE_FS} - li / {DENSE_FS} > 0.5 THEN 'SEM' ELSE 'REM' END AS EM_Type
  FROM ev JOIN gated g ON g.session_id = ev.session_id AND g.sample_idx = ev.i WHERE abs(l) <= 150 AND abs(r) <= 150)"""


def detected(spark, sf):
    """Raw dense signal to movements and sub-epochs; the hypnogram holds each epoch's first stage."""
    d = fx.dense_table(spark, sf).select(KEY, "sample_idx", "LOC", "ROC", "stage")
    epoch = F.floor(F.col("sample_idx") / (DETECT.epoch_s * DENSE_FS)).cast("long")
    hypnogram = d.groupBy(KEY, epoch.alias("epoch_idx")).agg(clean.stage_encode(F.min_by("stage", "sample_idx")).alias("stage_code"))
    return night.detect(d, hypnogram, DETECT, TAPS, chunk_rows=128)


@query("detect", with_views("dense", body=f", {RAW_TO_EVENTS} SELECT * FROM em"))
def detect(spark, sf):
    out = detected(spark, sf)[0]
    return out.select(*[F.round(F.pi() * F.col(c), 4).alias(c) if c.endswith("Slope") else F.round(c, 4).alias(c) if c == "MeanAbsValPeak" else F.col(c) for c in out.columns])


@query("detect_subepochs", with_views("dense", body=f""", {RAW_TO_EVENTS},
h AS (SELECT session_id, sample_idx // 32 AS e, arg_min(stage, sample_idx) AS stage, FROM dense GROUP BY 1, 2),
n AS (SELECT session_id, count(*) / {DENSE_FS} AS dur FROM dense GROUP BY 1),
g AS (SELECT h.session_id, e, unnest(range(4 * e, 4 * e + 4)) AS slot FROM h WHERE stage = 'REM')
SELECT g.session_id, slot * 0.5e0 AS SubEpochStart, slot * 0.5e0 + 0.5e0 AS SubEpochEnd, CAST(e AS INTEGER) AS EpochIdx,
  CASE WHEN coalesce(sum(em.Duration), 0) >= 0.25 THEN 'Phasic' ELSE 'Tonic' END AS EpochType
FROM g JOIN n USING (session_id) LEFT JOIN em ON em.session_id = g.session_id AND floor(em.Peak / 0.5e0) = slot WHERE slot * 0.5e0 + 0.5e0 <= dur GROUP BY 1, 2, 3, 4"""))
def detect_subepochs(spark, sf):
    return detected(spark, sf)[1]


PARTS = ("stage_distribution", "rem_epoch_duration", "rem_event_features", "em_classification", "em_stage_counts", "phasic_tonic", "eog_amplitude")
REST = ("stage_probability", "rem_stability", "bout_features", "bout_structure", "em_morphology", "sleep_architecture", "waso")


def _joined(names) -> str:
    first, *rest = [f"({ORACLE[n]})" for n in names]
    return f"SELECT * FROM {first} p0 " + " ".join(f"JOIN {r} p{i} USING (session_id)" for i, r in enumerate(rest, 1))


@query("eog_features", _joined(PARTS))
def eog_features(spark, sf):
    return eog.eog_features(fx.merged_table(spark, sf), FS, CHUNK_S, SUB_S)


#: The dense grid's sampling rate, sub-epoch and long bout, in place of the sparse night's.
DENSE_SUB_S, DENSE_LONG_S = 0.5, 1.5
ON_DENSE = {f"/ {FS}e0": f"/ {DENSE_FS}e0", f"{SUB_S}": f"{DENSE_SUB_S}", "30000": f"{DENSE_LONG_S}"}


def on_dense(name: str) -> str:
    """A feature group's SQL over the dense night instead of the merged timeline."""
    body = ORACLE[name].removeprefix(with_views("merged", body=""))
    for old, new in ON_DENSE.items():
        body = body.replace(old, new)
    return with_views("dense_night", body="") + ", merged AS (SELECT * FROM dense_night)" + body


SPECTRA = ("band_power_stage", "band_power_context")


@query("session_features", "SELECT * FROM " + " JOIN ".join(
    f"({sql}) p{i}" + (" USING (session_id)" if i else "") for i, sql in enumerate([on_dense(n) for n in (*PARTS, *REST)] + [ORACLE[n] for n in SPECTRA])))
def session_features(spark, sf):
    """All 141 features and the wake after sleep onset, from three scans of the timeline."""
    out = fused.night_features(
        fx.dense_night(spark, sf), DENSE_FS, DCHUNK, DENSE_SUB_S, DENSE_LONG_S, 32, SEG_S, MIN_S, 2.0, BANDS, CTX)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_power") else F.col(c) for c in out.columns])


@query("module_dispatch", f"SELECT * FROM ({ORACLE['rem_stability']}) a JOIN ({ORACLE['stage_probability']}) b USING (session_id)")
def module_dispatch(spark, sf):
    """A module that lacks its columns is skipped, the others are built."""
    m = fx.merged_table(spark, sf).drop("EpochType")
    out, failed = night.extract(m, ("bout", "stage_prob"), night.Settings(fs=FS, chunk_s=CHUNK_S), with_waso=False)
    assert list(failed) == ["bout"]
    return out
