"""Patient labels looked up per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators.clean import id_extract
from sleepsignal.schemas import SESSION_ID

GROUP_COLS = ("Control", "PD(-RBD)", "PD(+RBD)", "iRBD", "PLM")
ROW_COL = "row_id"


def patient_features(
    sessions: DataFrame, patients: DataFrame, subject: str = "subject_id", patient_id: str = "patient_id", pattern: str = SESSION_ID,
    cols: Sequence[str] = GROUP_COLS,
) -> DataFrame:
    """0/1 labels of the first patient row with the session's id; 0 where there is none."""
    have = [c for c in cols if c in patients.columns]
    order = ROW_COL if ROW_COL in patients.columns else have[0] if have else patient_id
    first = patients.filter(F.col(patient_id).isNotNull()).groupBy(F.col(patient_id).alias("_pid")).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in have], F.lit(True).alias("_hit")), F.col(f"`{order}`")).alias("_p"))
    s = sessions.withColumn("_pid", id_extract(F.col(subject), pattern))
    label = lambda c: F.coalesce(F.col("_p").getField(c).cast("int"), F.lit(0)) if c in have else F.lit(0)
    return s.join(first, "_pid", "left").select(subject, F.col("_pid").alias(patient_id), *[label(c).alias(c) for c in cols])
