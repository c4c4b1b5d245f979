"""Registered queries against their SQL, and the shape of the sample-level plans."""

import re

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
FAST = (
    "merged_timeline", "asof_interval", "asof_nearest", "nearest_sample_flag", "event_range_mask", "stage_runs", "bouts", "detect_movements",
    "session_features", "band_power_stage", "band_power_context", "bandpass_filter", "patient_lookup", "make_labels", "module_outer_merge",
    "describe_features", "histogram", "boxplot_stats", "importance_stability", "univariate_table_u", "delong_test", "bootstrap_auc", "roc_curve",
    "classification_metrics", "stratified_folds", "session_index", "lights_qc", "pending_inventory", "incremental_ingest", "channel_rename",
    "min_spacing", "module_tables", "sink_tables", "trim_lights", "time_offset", "effect_outer", "macro_auc", "qq_points", "shapiro_summary", "normality_overview", "choose_test", "univariate_table", "pca_2d", "interval_label_overlapping",
    "ingest_rejects", "detect", "detect_subepochs",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    got = check.canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == check.canon([d[0] for d in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["merged_timeline", "asof_interval", "stage_runs", "detect_movements", "interpolate_nulls", "delong_components", "mann_whitney"])
def test_windows_over_rows_are_split_by_chunk(spark, name):
    """No window orders a whole session: row windows name the chunk, chunk windows read summaries."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [ln for ln in plan.splitlines() if re.search(r"\bWindow \[", ln)]
    assert windows
    for ln in windows:
        spec = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", ln)
        assert all("_chunk" in s or re.search(r"_b#", s) for s in spec), ln[:300]
    assert "CartesianProduct" not in plan and "Join Cross" not in plan
