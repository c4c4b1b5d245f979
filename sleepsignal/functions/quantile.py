"""Exact interpolated quantiles without holding a large group in one aggregation buffer.

``percentile`` keeps every distinct value of a group in one map.  Here groups of up to ``small``
values are sorted as one array each.  For the larger ones a histogram over buckets cut at
approximate quantiles (partial aggregation, at most ``n_buckets`` rows per group) finds the bucket
that holds each wanted rank; only its values are ordered.  The cuts of a group are as large as
hundreds of values, so a table of many small groups must not carry any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.plans.chunked import with_value_chunk
from sleepsignal.session import cut

N_BUCKETS = 512
SMALL = 4096


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], n_buckets: int = N_BUCKETS, small: int = SMALL
) -> DataFrame:
    """One row per key with a column for each entry of ``probs`` (name -> probability); keys with a NULL give none.

    The keys of more than ``small`` values are found first, by a count that is run at once.
    """
    keys = list(keys)
    there = F.col("_v").isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    # zero has one sign, as in a grouping
    data = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).filter(there)
    large = cut(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > small).select(*keys))
    if large.isEmpty():
        return _of_small(data, keys, probs)
    rest = _of_small(data.join(large, keys, "left_anti"), keys, probs)
    return rest.unionByName(_of_large(data.join(large, keys, "left_semi"), keys, probs, n_buckets))


def _of_small(data: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Every group is sorted as one array."""
    d = data.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_a")).withColumn("_n", F.size("_a"))
    out = []
    for n, p in probs.items():
        s = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = (F.get("_a", f(s).cast("int")) for f in (F.floor, F.ceil))
        out.append((lo + (hi - lo) * (s - F.floor(s))).alias(n))
    return d.select(*keys, *out)


def _of_large(data: DataFrame, keys: list[str], probs: dict[str, float], n_buckets: int) -> DataFrame:
    """Only the values of the buckets that hold a wanted rank are ordered."""
    bucketed = with_value_chunk(data, keys, "_v", n_buckets, "_b")
    hist = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    every = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = hist.withColumn("_n", F.sum("_m").over(every))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_below", F.sum("_m").over(upto) - F.col("_m"))

    def inside(start: Column, count: Column, rank: Column) -> Column:
        return (rank >= start) & (rank < start + count)

    spots = {n: F.lit(float(p)) * (F.col("_n") - 1) for n, p in probs.items()}
    wanted = F.lit(False)
    for s in spots.values():
        wanted = wanted | inside(F.col("_below"), F.col("_m"), F.floor(s)) | inside(F.col("_below"), F.col("_m"), F.ceil(s))
    targets = hist.filter(wanted).select(*keys, "_b", "_below", "_n")
    values = bucketed.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_m")).join(targets, [*keys, "_b"])
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_start", F.col("_below") + F.sum("_m").over(inner) - F.col("_m"))
    aggs = []
    for n, s in spots.items():
        lo = F.max(F.when(inside(F.col("_start"), F.col("_m"), F.floor(s)), F.col("_v")))
        hi = F.max(F.when(inside(F.col("_start"), F.col("_m"), F.ceil(s)), F.col("_v")))
        frac = F.max(s - F.floor(s))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    return values.groupBy(*keys).agg(*aggs)
