"""Row-level cleaning: channel names, trimming, masking, labels and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from sleepsignal.plans.chunked import Run, join_salted, running, with_time_chunk
from sleepsignal.schemas import KEY, SESSION_ID, STAGE_CODES, STAGES, T, require

ARTEFACT_UV = 300.0


def channel_rename(channels: DataFrame) -> DataFrame:
    """Channel that becomes LOC and channel that becomes ROC, one row per session.

    Input: session_id, ch_idx, ch_name.  A column is NULL where nothing is renamed.
    """
    name = F.upper(F.trim("ch_name"))
    rest = F.regexp_replace(name, "EOG", "")
    is_eog = F.upper("ch_name").contains("EOG")
    left = is_eog & rest.rlike("[LV]") & ~rest.rlike("[RH]")
    right = is_eog & rest.rlike("[RH]") & ~rest.rlike("[LV]")

    def first(cond: Column) -> Column:
        return F.min_by("ch_name", F.when(cond, F.col("ch_idx")))

    per = channels.groupBy(KEY).agg(
        F.max(F.when(name == "LOC", 1).otherwise(0)).alias("has_loc"),
        F.max(F.when(name == "ROC", 1).otherwise(0)).alias("has_roc"),
        F.count_if(is_eog).alias("n_eog"),
        first(left).alias("l"),
        first(right).alias("r"),
        F.min_by("ch_name", F.when(is_eog, F.col("ch_idx"))).alias("e1"),
        F.max_by("ch_name", F.when(is_eog, F.col("ch_idx"))).alias("e2"),
    )
    two = F.col("n_eog") == 2
    other = lambda c: F.when(F.col("e1") != F.col(c), F.col("e1")).when(F.col("e2") != F.col(c), F.col("e2"))
    loc = F.when(F.col("l").isNotNull(), F.col("l")).when(two & F.col("r").isNull(), F.col("e1")).when(two, other("r"))
    roc = F.when(F.col("r").isNotNull(), F.col("r")).when(two & F.col("l").isNull(), F.col("e2")).when(two, other("l"))
    return per.select(
        KEY,
        F.when(F.col("has_loc") == 0, loc).alias("loc_source"),
        F.when(F.col("has_roc") == 0, roc).alias("roc_source"),
    )


def channel_names(channels: DataFrame) -> DataFrame:
    """Distinct names of eye channels, sorted."""
    return (
        channels.filter(F.upper("ch_name").rlike("EOG|LOC|ROC|E1|E2")).select("ch_name").distinct().orderBy("ch_name")
    )


def trim_lights(df: DataFrame, lights: DataFrame, t: str = T) -> DataFrame:
    """Rows with lights_off <= t <= lights_on; a session without a lights row, or a limit that is NULL, is kept whole."""
    cond = (F.col(t) >= F.coalesce("lights_off", t)) & (F.col(t) <= F.coalesce("lights_on", t))
    return join_salted(df, lights.select(KEY, "lights_off", "lights_on"), [KEY], "left").filter(cond).select(*df.columns)


def time_offset(df: DataFrame, lights: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shift recording-relative times by lights_off; by nothing where a session has no lights row."""
    off = join_salted(df, lights.select(KEY, "lights_off"), [KEY], "left")
    return off.select(*[(F.col(c) + F.coalesce("lights_off", F.lit(0.0))).alias(c) if c in cols else F.col(c) for c in df.columns])


def mask_artefacts(df: DataFrame, limit: float = ARTEFACT_UV) -> DataFrame:
    """Both channels NULL where either exceeds the limit."""
    bad = F.coalesce(F.abs("LOC") > limit, F.lit(False)) | F.coalesce(F.abs("ROC") > limit, F.lit(False))
    return df.withColumns({"LOC": F.when(~bad, F.col("LOC")), "ROC": F.when(~bad, F.col("ROC"))})


def artefact_report(df: DataFrame, limit: float = ARTEFACT_UV) -> DataFrame:
    bad = (F.abs("LOC") > limit) | (F.abs("ROC") > limit)
    return df.groupBy(KEY).agg(
        F.count_if(bad).alias("n_masked"), (F.count_if(bad) / F.count(F.lit(1))).alias("masked_fraction")
    )


def unit_sanity(df: DataFrame, lo: float = 1.0, hi: float = 5000.0) -> DataFrame:
    """Largest absolute value per channel in microvolt and whether the session is usable."""
    ok = lambda c: F.col(c).between(lo, hi)
    return df.groupBy(KEY).agg(
        F.max(F.abs("LOC")).alias("loc_max_abs"), F.max(F.abs("ROC")).alias("roc_max_abs")
    ).withColumn("usable", F.coalesce(ok("loc_max_abs") & ok("roc_max_abs"), F.lit(False)))


def to_microvolt(df: DataFrame, cols: Sequence[str] = ("LOC", "ROC")) -> DataFrame:
    return df.withColumns({c: F.col(c) * 1e6 for c in cols})


def signal_range(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (KEY,)) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def stage_encode(stage: Column) -> Column:
    """Stage name to code; unknown names and NULL become wake (0)."""
    out = F.when(stage == STAGES[0], STAGE_CODES[STAGES[0]])
    for s in STAGES[1:]:
        out = out.when(stage == s, STAGE_CODES[s])
    return F.coalesce(out, F.lit(0)).cast("int")


def stage_decode(code: Column) -> Column:
    out = F.when(code == 0, STAGES[0])
    for s in STAGES[1:]:
        out = out.when(code == STAGE_CODES[s], s)
    return out


def stage_normalise(stage: Column) -> Column:
    return F.upper(F.trim(stage))


def drop_artefact_events(events: DataFrame, limit: float = ARTEFACT_UV) -> DataFrame:
    require(events, ["Start", "Peak", "End", "LOCAbsValPeak", "ROCAbsValPeak"])
    return events.filter((F.col("LOCAbsValPeak") <= limit) & (F.col("ROCAbsValPeak") <= limit))


def artefact_event_report(events: DataFrame, limit: float = ARTEFACT_UV) -> DataFrame:
    keep = (F.col("LOCAbsValPeak") <= limit) & (F.col("ROCAbsValPeak") <= limit)
    n = F.count(F.lit(1))
    return events.groupBy(KEY).agg(
        n.alias("n_events"), F.count_if(~keep).alias("n_removed"), (F.count_if(~keep) / n).alias("removed_fraction")
    )


def em_type(duration: Column, sem_s: float = 0.5) -> Column:
    return F.when(duration > sem_s, F.lit("SEM")).otherwise(F.lit("REM"))


def id_extract(name: Column, pattern: str = SESSION_ID) -> Column:
    """First session identifier inside a name, else the name itself."""
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), name)


def parse_class(value: Column) -> Column:
    """Label value as struct(kind, num, txt): integer, float or plain string."""
    whole = value.rlike("^[0-9]+$")
    num = F.expr("NULL") if value is None else value.try_cast("double")
    kind = F.when(whole, "int").when(num.isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("kind"), num.alias("num"), F.when(num.isNull(), value).alias("txt"))


def interpolate_nulls(
    df: DataFrame, idx: str, cols: Sequence[str], chunk_rows: int = 900_000
) -> DataFrame:
    """Linear fill by sample index; the ends hold the nearest value."""
    runs = []
    for c in cols:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).alias("v")))
        runs += [Run(f"_b_{c}", point, "last"), Run(f"_a_{c}", point, "next")]
    out = running(with_time_chunk(df, idx, chunk_rows), [KEY], [idx], runs)
    filled = {}
    for c in cols:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        slope = (a.v - b.v) / (a.i - b.i)
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), a.v).when(a.isNull(), b.v)
            .otherwise(b.v + slope * (F.col(idx) - b.i))
        )
    return out.withColumns(filled).select(*df.columns)


def residual_signal(df: DataFrame, idx: str = "sample_idx", fs: float = 128.0, lights_off: Column | None = None) -> DataFrame:
    """EEG estimate: raw minus filtered, per channel; time from the sample index."""
    require(df, [KEY, idx, "LOC", "ROC", "loc_clean", "roc_clean"])
    t = F.col(idx) / F.lit(float(fs))
    return df.select(
        KEY, (t if lights_off is None else t + lights_off).alias(T),
        (F.col("LOC") - F.col("loc_clean")).alias("EEG_LOC"), (F.col("ROC") - F.col("roc_clean")).alias("EEG_ROC"),
    )


def numeric_feature_cols(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, Ty.NumericType) and f.name not in set(exclude)]


def select_present(df: DataFrame, ids: Sequence[str], wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Wanted columns that exist, in the wanted order, and the names that do not."""
    have = set(df.columns)
    return df.select(*ids, *[c for c in wanted if c in have]), [c for c in wanted if c not in have]


def coalesce_suffixes(df: DataFrame, drop: Sequence[str] = ("DCSM_ID",)) -> DataFrame:
    """X_x / X_y become X (first non-null); *_dup and the alias id column go."""
    names = [c for c in df.columns if c not in drop and not c.endswith("_dup")]
    have = set(names)
    pairs = [c[:-2] for c in names if c.endswith("_x") and f"{c[:-2]}_y" in have]
    gone = {f"{b}{s}" for b in pairs for s in ("_x", "_y")}
    return df.select(
        *[F.col(f"`{c}`") for c in names if c not in gone],
        *[F.coalesce(F.col(f"`{b}_x`"), F.col(f"`{b}_y`")).alias(b) for b in pairs],
    )
