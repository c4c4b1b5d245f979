"""Paired bootstrap of AUCs by ranks: scores are ranked once, replicates only count.

1. Every subject has a number and, per model, the dense rank of its score (ties share one).
2. Each model's subjects are dealt by rank to blocks; the blocks are repeated for every group of replicates.
3. A (block, group) draws its replicates itself, slice by slice, counts how often its own subjects came up, and hands on
   sums: those of its first and its last rank, which may go on in the next block, and those of all ranks between.
4. The sums of a replicate are joined by their ranks.

Draws are a function of position and replicate, so none is ever sent: what travels is the subjects, once per group, and at
most three rows per (replicate, model, block). Every block draws anew, so the time grows with draws times blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.plans.chunked import CHUNK, Run, join_salted, running, with_value_chunk

# Fixed value: modulus of the draw generator (a Mersenne prime, so squares fit 64 bits).
PRIME = 2147483647
BLOCK = 1 << 18
DRAWS = 1 << 20
GROUPS = 64


def drawn(i: np.ndarray, b: int, n: int, seed: int) -> np.ndarray:
    """``compare.draw`` over arrays: the subjects drawn at positions ``i`` of replicate ``b``."""
    x = ((i + 1) * 48271 + (b + 1) * 69621 + seed) % PRIME
    y = (x * x + (seed + 12345)) % PRIME
    return (y * y + x) % PRIME % n


def ranked_blocks(num: DataFrame, models: Sequence[str], block: int) -> DataFrame:
    """(model, i, y, rank, block) of every score that is there; ties share a rank, a value of many subjects is dealt over its blocks."""
    cells = F.array(*[F.struct(F.lit(k).alias("model"), F.col(m).cast("double").alias("_v")) for k, m in enumerate(models)])
    y = F.coalesce(F.col("y_true").cast("int"), F.lit(-1)).alias("y")
    long = num.select("i", y, F.explode(cells).alias("_s")).select("i", "y", "_s.*").filter(F.col("_v").isNotNull())
    values = with_value_chunk(long.groupBy("model", "_v").agg(F.count(F.lit(1)).alias("_c")), ["model"], "_v")
    ranks = running(values, ["model"], ["_v"], [Run("rank", F.lit(1).cast("long"), "sum"), Run("_upto", F.col("_c"), "sum")]).drop(CHUNK)
    at = F.col("_upto") - F.col("_c") + F.pmod(F.xxhash64("i"), F.col("_c"))
    return join_salted(long, ranks, ["model", "_v"]).select("model", "i", "y", "rank", F.floor(at / block).cast("long").alias("block"))


def times_drawn(own: np.ndarray, b: int, n: int, seed: int, draws: int) -> np.ndarray:
    """How often replicate ``b`` draws each of the sorted subjects ``own``, a slice of the draws at a time."""
    w = np.zeros(len(own), np.int64)
    for lo in range(0, n, draws):
        x = drawn(np.arange(lo, min(n, lo + draws)), b, n, seed)
        if len(own) < n:
            at = np.minimum(np.searchsorted(own, x), len(own) - 1)
            x = at[own[at] == x]
        w += np.bincount(x, minlength=len(own))
    return w


def replicate_aucs(num: DataFrame, models: Sequence[str], n: int, n_boot: int, seed: int = 42, block: int = BLOCK, draws: int = DRAWS, groups: int = GROUPS) -> DataFrame:
    """(replicate, model, auc) of every model in every resample; NULL where a class is missing. ``num`` has i, y_true and the scores."""
    cells = F.array_sort(F.collect_list(F.struct("rank", "i", "y")))
    subjects = ranked_blocks(num, models, block).groupBy("model", "block").agg(cells.alias("_s"))
    subjects = subjects.select("model", "block", *[F.col("_s")[c].alias(c) for c in ("rank", "i", "y")], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    names, types = ["replicate", "model", "rank", "edge", "pos", "neg", "u"], (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.float64()] * 3)

    def count(rows: pa.Table) -> pa.Table:
        group, sides, found = rows.column("group")[0].as_py(), [], []
        for k, *one in zip(rows.column("model").to_pylist(), *[rows.column(c).combine_chunks() for c in ("rank", "i", "y")], strict=True):
            rank, i, y = (x.values.to_numpy() for x in one)
            own, at = np.unique(i, return_inverse=True)
            distinct, first = np.unique(rank, return_index=True)
            sides.append((k, own, at, y, distinct, first))
        for b in range(group, n_boot, groups):
            counted: list[tuple] = []
            for k, own, at, y, distinct, first in sides:
                w = next((w for o, w in counted if np.array_equal(o, own)), None)
                if w is None:
                    w = times_drawn(own, b, n, seed, draws)
                    counted.append((own, w))
                pos, neg = (np.add.reduceat(np.where(y == label, w[at], 0), first).astype(float) for label in (1, 0))
                ends = sorted({0, len(distinct) - 1})
                found += [(b, k, distinct[e], True, pos[e], neg[e], 0.0) for e in ends]
                if len(distinct) > 2:
                    p, q = pos[1:-1], neg[1:-1]
                    found.append((b, k, distinct[1], False, p.sum(), q.sum(), (p * (np.cumsum(q) - q / 2)).sum()))
        return pa.Table.from_arrays([pa.array([row[c] for row in found], t) for c, t in enumerate(types)], names)

    # As many partitions as groups were asked for: the blocks are small in bytes, the work on them is not.
    dealt = subjects.repartition(2 * groups, "block", "group")
    sums = dealt.groupBy("block", "group").applyInArrow(count, "replicate long, model int, rank long, edge boolean, pos double, neg double, u double")
    whole = sums.groupBy("replicate", "model", "rank").agg(F.max("edge").alias("edge"), *[F.sum(c).alias(c) for c in ("pos", "neg", "u")])
    before = Window.partitionBy("replicate", "model").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    ties = F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("u"))
    u = F.sum(ties + F.col("pos") * F.col("_below"))
    return whole.groupBy("replicate", "model").agg((u / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
