"""Column names, table schemas and checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

KEY = "session_id"
T = "time_sec"

# Stage names in code order, their integer codes, and the sleep stages.
STAGES = ("W", "N1", "N2", "N3", "REM")
STAGE_CODES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4}
SLEEP_STAGES = ("N1", "N2", "N3", "REM")
PROB_COLS = ("prob_w", "prob_n1", "prob_n2", "prob_n3", "prob_rem")

# Session folder and identifier patterns of the cohort.
SESSION_FOLDER = r"^DCSM_(\d+)_([abc])$"
SESSION_ID = r"(DCSM_\d+_[a-zA-Z])"


def _doubles(*names: str) -> list[Ty.StructField]:
    return [Ty.StructField(n, Ty.DoubleType()) for n in names]


_KEY = Ty.StructField(KEY, Ty.StringType())
_EVENT = _doubles(
    "Start", "Peak", "End", "Duration", "LOCAbsValPeak", "ROCAbsValPeak",
    "LOCAbsRiseSlope", "ROCAbsRiseSlope", "LOCAbsFallSlope", "ROCAbsFallSlope",
)

EOG = Ty.StructType([_KEY, *_doubles(T, "LOC", "ROC")])
STAGING = Ty.StructType([_KEY, *_doubles("epoch_start"), Ty.StructField("stage", Ty.StringType()), *_doubles(*PROB_COLS)])
REM_EVENTS = Ty.StructType([_KEY, Ty.StructField("event_id", Ty.LongType()), *_EVENT, Ty.StructField("Stage", Ty.StringType())])
EM_EVENTS = Ty.StructType([*REM_EVENTS.fields, *_doubles("MeanAbsValPeak"), Ty.StructField("EM_Type", Ty.StringType())])
SUBEPOCHS = Ty.StructType([
    _KEY, *_doubles("SubEpochStart", "SubEpochEnd"), Ty.StructField("EpochIdx", Ty.IntegerType()),
    Ty.StructField("EpochType", Ty.StringType()),
])
EEG = Ty.StructType([_KEY, *_doubles(T, "EEG_LOC", "EEG_ROC")])
LIGHTS = Ty.StructType([_KEY, *_doubles("lights_off", "lights_on")])


def require(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Raise ValueError naming the required columns that are missing."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}; found: {df.columns}")
    return df
