"""Cohort tables: joins of features with patients, diagnostic groups and class labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleepsignal.operators.features.patient import GROUP_COLS

# Class codes of each task.
BINARY_LABELS = {
    "control_vs_all": {"Control": 0, "iRBD": 1, "PD(+RBD)": 1},
    "control_vs_irbd": {"Control": 0, "iRBD": 1},
    "control_vs_pd": {"Control": 0, "PD(+RBD)": 1},
}
MULTICLASS_LABELS = {"Control": 0, "iRBD": 1, "PD(-RBD)": 2, "PD(+RBD)": 3}

# Columns of the clinical baseline model.
SPECTRAL_BASELINE = tuple(
    [f"eeg__{s}__{b}" for s in ("w", "n1", "n2", "n3", "rem") for b in ("delta", "theta", "alpha", "beta", "total", "theta_ratio")]
    + ["eeg__overall__theta_beta_ratio"]
    + [f"eeg_{b}" for c in ("rem", "phasic", "tonic") for b in (f"delta_{c}_power", f"theta_{c}_power", f"gamma_{c}_power", f"theta_delta_ratio_{c}")]
    + ["waso_min"]
)
MACRO_BASELINE = (
    "total_recording_min", "w_duration_min", "w_fraction", "n1_duration_min", "n1_fraction", "n2_duration_min", "n2_fraction",
    "n3_duration_min", "n3_fraction", "rem_duration_min", "rem_fraction", "rem_latency_min", "n_rem_cycles", "n_rem_epochs",
    "rem_epoch_count", "rem_epoch_mean_duration_min", "rem_epoch_std_duration_min", "rem_epoch_min_duration_min", "rem_epoch_max_duration_min",
)


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def _any_positive(df: DataFrame, cols: Sequence[str]) -> Column:
    have = [n for n in cols if n in df.columns]
    if not have:
        return F.lit(False)
    total = reduce(lambda a, b: a + b, [F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in have])
    return total > 0


def _is_set(df: DataFrame, name: str) -> Column:
    return F.coalesce(c(name) == 1, F.lit(False)) if name in df.columns else F.lit(False)


def assign_group(df: DataFrame, rule: str = "label") -> Column:
    """Diagnostic group from 0/1 indicator columns.

    ``label``: Unknown without any positive indicator; PLM counts as Control and wins over
    all others.  ``info``: any non-null indicator is enough to be Control.  ``plot``:
    Control by default, Control = 1, PLM or DG473 win over all others.
    """
    yes = lambda n: _is_set(df, n)
    if rule == "plot":
        control, default = yes("Control") | yes("PLM") | yes("DG473"), F.lit("Control")
    else:
        control = yes("PLM")
        if rule == "label":
            info = _any_positive(df, GROUP_COLS)
        elif rule == "info":
            info = reduce(lambda a, b: a | b, [c(n).isNotNull() for n in GROUP_COLS if n in df.columns], F.lit(False))
        else:
            raise ValueError(f"unknown rule {rule!r}")
        default = F.when(info, "Control").otherwise("Unknown")
    return (
        F.when(control, "Control").when(yes("iRBD"), "iRBD").when(yes("PD(+RBD)"), "PD(+RBD)").when(yes("PD(-RBD)"), "PD(-RBD)").otherwise(default)
    )


def map_labels(group: Column, mapping: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, code in mapping.items():
        out = F.when(group == name, F.lit(code)).otherwise(out)
    return out


def make_labels(df: DataFrame, mode: str = "binary", task: str = "control_vs_all", group: str = "group") -> DataFrame:
    """Rows with a class label for the task; the others are dropped."""
    if mode == "multiclass":
        mapping = MULTICLASS_LABELS
    elif task in BINARY_LABELS:
        mapping = BINARY_LABELS[task]
    else:
        raise ValueError(f"unknown task {task!r}; use one of {sorted(BINARY_LABELS)}")
    return df.withColumn("y", map_labels(c(group), mapping)).filter(F.col("y").isNotNull())


def class_counts(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def patient_info(features: DataFrame, patients: DataFrame, on: str, keep: Sequence[str]) -> DataFrame:
    """Left join of the demographic columns that exist; repeated patient rows multiply."""
    have = [n for n in keep if n in patients.columns and n != on]
    return features.join(patients.select(c(on), *[c(n) for n in have]), on, "left")


def unmatched(features: DataFrame, patients: DataFrame, on: str) -> DataFrame:
    return features.join(patients.select(on), on, "left_anti")


def outer_merge(modules: Sequence[DataFrame], on: str = "subject_id") -> DataFrame:
    """Full outer join of module tables; the left copy of a repeated column wins."""
    out = modules[0]
    for m in modules[1:]:
        new = [n for n in m.columns if n == on or n not in out.columns]
        out = out.join(m.select(*[c(n) for n in new]), on, "full")
    return out


def append_column(features: DataFrame, extra: DataFrame, on: str, name: str, overwrite: bool = True) -> DataFrame:
    """Left join one column; an existing one is replaced, or kept when ``overwrite`` is off."""
    if name in features.columns:
        if not overwrite:
            return features
        features = features.drop(name)
    return features.join(extra.select(c(on), c(name)), on, "left")


def exclude(df: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is not listed, and the listed ids that do not occur."""
    listed = ids.select(on).distinct()
    return df.join(listed, on, "left_anti"), listed.join(df.select(on), on, "left_anti")


def label_audit(df: DataFrame, cols: Sequence[str] = GROUP_COLS) -> DataFrame:
    """Sessions with and without a label, and the count per label."""
    labelled = _any_positive(df, cols)
    parts = [F.count_if(labelled).alias("with_label"), F.count_if(~labelled).alias("without_label")]
    parts += [F.count_if(c(n) == 1).alias(f"n_{n}") for n in cols if n in df.columns]
    return df.agg(*parts)


def unlabelled_ids(df: DataFrame, on: str, cols: Sequence[str] = GROUP_COLS) -> DataFrame:
    return df.filter(~_any_positive(df, cols)).select(on)
