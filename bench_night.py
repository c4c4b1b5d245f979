"""Time the features of one full night in a single session (8 h at 250 Hz by default): python bench_night.py [hours] [old]

The night is generated: the driver tables hold no session of that length.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import functions as F

from sleepsignal.catalog.fixtures import DENSE_COLS
from sleepsignal.operators.features import fused
from sleepsignal.plans import night
from sleepsignal.schemas import KEY, T
from sleepsignal.session import cut, discard_stages, get_spark

FS = 250.0


def timeline(spark, hours: float):
    """30 s epochs in five stages, 4 s sub-epochs, events of 0.6 s every 5 and 3 s, sine signals."""
    n = int(hours * 3600 * FS)
    d = spark.range(n).select(F.lit("night").alias(KEY), F.col("id").alias("sample_idx"), (F.col("id") / FS).alias(T))
    stage = F.element_at(F.array(*map(F.lit, ("W", "N1", "N2", "REM", "N3", "REM"))), (F.floor(F.col(T) / 30) % 6 + 1).cast("int"))
    d = d.withColumns({"stage": stage, "LOC": F.sin(F.col(T) * 3) * 80, "ROC": -F.sin(F.col(T) * 3 + 0.1) * 70, "EEG_LOC": F.sin(F.col(T) * 40) * 20, "EEG_ROC": F.cos(F.col(T) * 55) * 15})
    d = d.withColumn("EpochType", F.when(stage == "REM", F.when(F.floor(F.col(T) / 4) % 3 == 0, "Phasic").otherwise("Tonic")))
    slow = {c: v.replace("sample_idx % 24 < 10", "sample_idx % 750 < 150").replace("sample_idx / 24e0", "sample_idx / 750e0").replace("sample_idx % 40 < 12", "sample_idx % 1250 < 150").replace(
        "sample_idx / 40e0", "sample_idx / 1250e0").replace("2.5e0", "5e0") for c, v in DENSE_COLS.items()}
    return d.selectExpr("*", *[f"{v} AS {c}" for c, v in slow.items()])


def main(argv: list[str]) -> None:
    spark = get_spark("night", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="night-")})
    spark.sparkContext.setLogLevel("ERROR")
    merged = cut(timeline(spark, float(argv[0]) if argv else 8.0))
    t = time.perf_counter()
    if "old" in argv:
        out, _ = night.extract(merged)
    else:
        out = fused.night_features(merged, FS, 600.0)
    row = out.collect()
    print(f"{merged.count()} samples, {len(out.columns) - 1} columns, {len(row)} row: {time.perf_counter() - t:.1f} s")
    discard_stages(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
