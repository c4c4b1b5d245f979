"""File inventories: which sessions exist, which are complete, which are done.

Every function works on a listing (path, length), so an inventory of millions of
files is a table like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleepsignal.schemas import KEY, SESSION_FOLDER

# Names of the raw files of a session, and of a stage's output.
RAW_FILES = {"edf": "contiguous.edf", "csv": "hypnogram.csv", "txt": "lights.txt"}
STAGE_SUFFIX = {
    "eog": r"_eog\.csv(\.gz)?$", "staging": r"_gssc\.csv(\.gz)?$", "rem_events": r"_extracted_rems\.csv(\.gz)?$", "em_events": r"_em\.csv(\.gz)?$",
    "subepochs": r"_subepochs\.csv(\.gz)?$", "eeg": r"_eeg\.csv(\.gz)?$", "merged": r"_merged\.csv(\.gz)?$",
}


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return r.load(root).select("path", "length")


def _folder(depth: int) -> Column:
    return F.try_element_at(F.split("path", "/"), F.lit(-1 - depth))


def session_index(
    listing: DataFrame, want: Sequence[str] = ("edf", "csv", "txt"), files: dict[str, str] = RAW_FILES, recursive: bool = False,
    strict: bool = False, pattern: str = SESSION_FOLDER,
) -> DataFrame:
    """One row per session folder that holds every wanted file.

    Non-recursive: the file lies directly in the session folder; recursive: anywhere below.
    ``strict`` raises when a session is incomplete; without any session an error is raised
    by ``require_sessions``.
    """
    parts = F.split("path", "/")
    if recursive:
        session = F.get(F.filter(parts, lambda p: p.rlike(pattern)), 0)
    else:
        session = F.when(_folder(1).rlike(pattern), _folder(1))
    base = listing.select("path", session.alias(KEY), F.element_at(parts, -1).alias("_file")).filter(F.col(KEY).isNotNull())
    got = base.groupBy(KEY).agg(*[F.min(F.when(F.col("_file") == files[k], F.col("path"))).alias(f"{k}_path") for k in want])
    complete = F.lit(True)
    for k in want:
        complete = complete & F.col(f"{k}_path").isNotNull()
    if strict:
        bad = got.filter(~complete).orderBy(KEY).first()
        if bad is not None:
            raise FileNotFoundError(f"incomplete session {bad[KEY]}: {bad.asDict()}")
    return got.filter(complete).select(
        F.col(KEY).alias("patient_id"), F.regexp_extract(KEY, pattern, 1).cast("int").alias("patient_number"),
        F.regexp_extract(KEY, pattern, 2).alias("session_type"), *[f"{k}_path" for k in want])


def require_sessions(index: DataFrame) -> DataFrame:
    if index.isEmpty():
        raise RuntimeError("no valid session folders found; check the root path or search recursively")
    return index


def sorted_index(index: DataFrame, out_root: str) -> DataFrame:
    """Adds the output folder and sorts by patient and session type."""
    return index.withColumn("out_dir", F.concat_ws("/", F.lit(out_root.rstrip("/")), "patient_id")).orderBy("patient_number", "session_type", "patient_id")


def stage_outputs(listing: DataFrame, pattern: str = r"([A-Za-z]+_\d+_[a-zA-Z])_") -> DataFrame:
    """(session, stage) of every non-empty stage output, in plain or compressed form."""
    name = F.element_at(F.split("path", "/"), -1)
    stage = F.lit(None).cast("string")
    for s, suffix in STAGE_SUFFIX.items():
        stage = F.when(name.rlike(suffix), F.lit(s)).otherwise(stage)
    d = listing.filter("length > 0").select(F.regexp_extract(name, pattern, 1).alias(KEY), stage.alias("stage"))
    return d.filter((F.col(KEY) != "") & F.col("stage").isNotNull()).distinct()


def empty_files(listing: DataFrame) -> DataFrame:
    """Zero-byte outputs, which count as missing."""
    return listing.filter("length = 0").select("path")


def pending(sessions: DataFrame, outputs: DataFrame, stage: str = "merged", batch_size: int | None = None) -> DataFrame:
    """Sessions without the stage's output, in order; at most ``batch_size`` of them."""
    done = outputs.filter(F.col("stage") == stage).select(F.col(KEY).alias("patient_id"))
    todo = sessions.join(done, "patient_id", "left_anti")
    return todo if batch_size is None else todo.orderBy("patient_number", "session_type", "patient_id").limit(batch_size)


def missing_stages(sessions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Which stage outputs exist per session."""
    o = outputs.groupBy(F.col(KEY).alias("patient_id")).agg(*[F.bool_or(F.col("stage") == s).alias(s) for s in STAGE_SUFFIX])
    return sessions.select("patient_id").join(o, "patient_id", "left").select("patient_id", *[F.coalesce(s, F.lit(False)).alias(s) for s in STAGE_SUFFIX])


def remerge_inventory(outputs: DataFrame, need: Sequence[str] = ("eeg", "eog", "staging", "rem_events", "em_events")) -> DataFrame:
    """Sessions that have every merge input."""
    o = outputs.filter(F.col("stage").isin(*need)).groupBy(KEY).agg(F.count_distinct("stage").alias("_n"))
    return o.filter(F.col("_n") == len(need)).select(KEY, F.concat(KEY, F.lit("_eog_merged.csv")).alias("output"))


def size_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files and bytes before and after compaction, and the bytes saved."""
    s = before.select(F.lit(0).alias("side"), "length").union(after.select(F.lit(1), "length"))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("length"))), F.lit(0)).cast("long")
    return s.agg(F.count_if(F.col("side") == 0).alias("files_before"), F.count_if(F.col("side") == 1).alias("files_after"),
                 side(0).alias("bytes_before"), side(1).alias("bytes_after")).withColumn("bytes_saved", F.col("bytes_before") - F.col("bytes_after"))
