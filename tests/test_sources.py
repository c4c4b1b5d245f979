"""Files in and out: inventories, lights, CSV, compaction, resume."""

import gzip

import pytest
from pyspark.sql import functions as F

from sleepsignal import schemas
from sleepsignal.sources import incremental, listing, tables
from sleepsignal.streaming.ingest import ingest, session_stream


@pytest.fixture
def raw(tmp_path):
    for s, names in {"DCSM_2_a": ["contiguous.edf", "hypnogram.csv", "lights.txt"], "DCSM_10_b": ["contiguous.edf", "lights.txt"],
                     "DCSM_1_c": ["sub/contiguous.edf", "hypnogram.csv", "lights.txt"], "other": ["contiguous.edf"], "DCSM_3_d": ["contiguous.edf"]}.items():
        for n in names:
            p = tmp_path / "raw" / s / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("Lights_ON , lights_off\n500,20\n" if n == "lights.txt" else "x")
    return str(tmp_path / "raw")


def test_session_index(spark, raw):
    files = listing.list_files(spark, raw)
    assert [r["patient_id"] for r in listing.session_index(files).collect()] == ["DCSM_2_a"]
    deep = listing.sorted_index(listing.session_index(files, recursive=True), "/out")
    assert [(r["patient_id"], r["out_dir"]) for r in deep.collect()] == [("DCSM_1_c", "/out/DCSM_1_c"), ("DCSM_2_a", "/out/DCSM_2_a")]
    with pytest.raises(FileNotFoundError):
        listing.session_index(files, strict=True)
    with pytest.raises(RuntimeError):
        listing.require_sessions(listing.session_index(files.filter("length < 0")))
    done = spark.createDataFrame([("DCSM_2_a", "merged")], "session_id string, stage string")
    assert [r["patient_id"] for r in listing.pending(deep, done, batch_size=5).collect()] == ["DCSM_1_c"]


def test_lights(spark, raw):
    p = tables.parse_lights(tables.read_lights(spark, raw))
    row = tables.usable_lights(p).first()
    assert (row["lights_off"], row["lights_on"], row["sleep_min"]) == (20.0, 500.0, 8.0)
    text = spark.createDataFrame([("a", "lights_off,lights_on\n0,0\n"), ("b", "lights_off,lights_on\n,5\n"), ("c", "x,y\n1,2\n"), ("d", "lights_off,lights_on")], "path string, text string")
    q = {r["path"]: r["issue"] for r in tables.lights_qc(tables.parse_lights(text)).collect()}
    assert q == {"a": "both zero", "b": "lights_off is zero", "c": "unreadable", "d": "both zero"}
    assert tables.usable_lights(tables.parse_lights(text)).filter("path = 'a'").isEmpty()


def test_csv_scan_and_compaction(spark, tmp_path):
    src = tmp_path / "eog"
    src.mkdir()
    body = "time_sec,LOC,ROC\n" + "".join(f"{i},{i}.5,{'bad' if i == 3 else -i}\n" for i in range(200))
    (src / "DCSM_7_a_x_eog.csv").write_text(body)
    with gzip.open(src / "DCSM_8_b_x_eog.csv.gz", "wt") as f:
        f.write("time_sec,LOC,ROC\n0,nan,1\n")
    d = tables.scan_csv(spark, str(src), schemas.EOG)
    assert {r["session_id"]: r["count"] for r in d.groupBy("session_id").count().collect()} == {"DCSM_7_a": 200, "DCSM_8_b": 1}
    assert d.filter("ROC IS NULL").count() == 1 and d.filter("LOC IS NULL").first()["session_id"] == "DCSM_8_b"
    with pytest.raises(ValueError, match="stage"):
        tables.scan_csv(spark, str(src), schemas.STAGING)
    dry = tables.compact(spark, str(src), str(tmp_path / "out"), schemas.EOG, dry_run=True).first()
    assert dry["bytes_saved"] == 0 and not (tmp_path / "out").exists()
    r = tables.compact(spark, str(src), str(tmp_path / "out"), schemas.EOG).first()
    assert r["files_before"] == 1 and r["files_after"] >= 1 and tables.scan_parquet(spark, str(tmp_path / "out"), ["LOC", "nope"]).columns == ["LOC"]


def test_rewriting_one_session_keeps_the_others(spark, tmp_path):
    out = str(tmp_path / "t")
    mk = lambda *rows: spark.createDataFrame(rows, "session_id string, v int")
    tables.write_table(mk(("a", 1), ("b", 2)), out)
    tables.write_table(mk(("b", 3)), out)
    assert {(r["session_id"], r["v"]) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 3)}


def test_incremental_skips_known_sessions(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "session_id string, v int")
    old = spark.createDataFrame([("a", 99, 0.5)], "session_id string, n long, legacy double")
    ext = lambda d: d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    got = {r["session_id"]: (r["n"], r["legacy"]) for r in incremental.incremental(s, old, ext, "session_id").collect()}
    assert got == {"a": (99, 0.5), "b": (2, None)}
    assert {r["n"] for r in incremental.incremental(s, old, ext, "session_id", force=True).collect()} == {1, 2}


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    put = lambda n: (src / f"{n}.csv").write_text(f"session_id,v\n{n},1\n{n},2\n")
    schema = "session_id string, v int"
    from pyspark.sql.types import _parse_datatype_string

    run = lambda: ingest(session_stream(spark, str(src), _parse_datatype_string(schema), "csv", 1), lambda d: d.groupBy("session_id").agg(F.sum("v").alias("s")), out, chk, 120)
    put("a"), put("b")
    run()
    assert {r["session_id"] for r in spark.read.parquet(out).collect()} == {"a", "b"} and spark.read.parquet(out).select("batch_id").distinct().count() == 2
    put("c")
    run()
    run()
    assert sorted((r["session_id"], r["s"]) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 3), ("c", 3)]
