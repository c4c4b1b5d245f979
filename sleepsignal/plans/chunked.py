"""Running functions over long ordered series, without putting a series in one task.

A plain ``Window.partitionBy(session).orderBy(t)`` sorts a whole session in one
task, so one long or popular session sets the run time of the job.  Every running
function here works in two levels instead:

1. rows are partitioned by ``(keys, chunk)``, where ``chunk`` is monotone in the
   ordering (a time bucket or a value bucket), and the function runs inside a chunk;
2. one summary row per chunk (built with partial aggregation) is run through a
   window over the chunks, and its result is carried into the rows by a join on
   ``(keys, chunk)``.

The window over chunks sees one row per chunk, never the samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


@dataclass(frozen=True)
class Run:
    """One running column.

    kind: ``sum`` (inclusive), ``last`` / ``next`` (nearest non-null value at or
    before / at or after the row), ``last_before`` / ``next_after`` (the same,
    current row excluded), ``lag`` / ``lead`` (value of the adjacent row), ``total``
    (sum over the whole key, taken from the chunk summaries).

    ``where`` names the rows that can hold a value, so that the chunk summary reads
    only those (in a union: only their branch).  ``monotone`` says the value itself
    grows with the ordering, so a plain maximum or minimum summarises a chunk.
    """

    name: str
    expr: Column
    kind: str
    where: str | None = None
    monotone: bool = False


BACKWARD = ("sum", "last", "last_before", "lag")
AHEAD = ("next", "next_after", "lead")


def with_time_chunk(df: DataFrame, t: str, length: float, name: str = CHUNK) -> DataFrame:
    return df.withColumn(name, F.floor(F.col(t) / F.lit(float(length))).cast("long"))


def with_value_chunk(
    df: DataFrame, keys: Sequence[str], value: str, n_chunks: int = 512, name: str = CHUNK, bound_keys: Sequence[str] | None = None, ties: str | None = None
) -> DataFrame:
    """Value buckets per key, cut at the key's approximate quantiles: an outlier moves no boundary.

    The number of chunks is the next power of two. Equal values share a chunk, unless ``ties`` names a column in
    [0, 1): a value that takes up several cuts leaves as many chunks empty behind its own, and its rows are dealt over
    them by ``ties``. The chunks then follow the order of (value, ``ties``). ``bound_keys`` (default: all keys) are
    those whose values are taken together for the boundaries.
    """
    by = list(keys if bound_keys is None else bound_keys)
    n = 1 << max(0, n_chunks - 1).bit_length()
    v = F.col(value).cast("double")
    if n == 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    cuts = df.groupBy(*by).agg(F.percentile_approx(v, [k / n for k in range(1, n)], 20 * n).alias("_cuts"))
    out = _search(join_salted(df, cuts, by), n, name, lambda cut: v > cut)
    if ties is not None:
        out = _search(out, n, "_beyond", lambda cut: v >= cut)
        out = out.withColumn(name, F.col(name) + F.floor(F.col(ties) * (F.col("_beyond") - F.col(name)))).drop("_beyond")
    return out.withColumn(name, F.col(name).cast("long")).drop("_cuts")


def _search(df: DataFrame, n: int, name: str, passed: Callable[[Column], Column]) -> DataFrame:
    """Number of the n - 1 sorted cuts that the value has passed, three halvings at a time."""
    out, step = df.withColumn(name, F.lit(0)), n
    while step > 1:
        deep = min(3, step.bit_length() - 1)
        out = out.withColumn(name, _descend(passed, F.col(name), step, deep))
        step >>= deep
    return out


def _descend(passed: Callable[[Column], Column], at: Column, step: int, deep: int) -> Column:
    """Place among the cuts after ``deep`` halvings of the ``step`` cuts from ``at`` on."""
    if not deep:
        return at
    half = step // 2
    beyond = passed(F.element_at("_cuts", at + half))
    return F.when(beyond, _descend(passed, at + half, half, deep - 1)).otherwise(_descend(passed, at, half, deep - 1))


def join_salted(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Attach one row per key to many rows, with every key spread over ``salts`` shares.

    The small table is repeated per share, so a key that holds a third of the rows is not one task's work.
    Spark still broadcasts it where it is small.
    """
    simple = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    share = F.pmod(F.xxhash64(*simple), F.lit(salts)).cast("int")
    small = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", share).join(small, [*keys, "_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    runs: Sequence[Run],
    order_ahead: Sequence[Column] | None = None,
    chunk: str = CHUNK,
    per_key: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add running columns.  ``order`` must be total inside a key and refine ``chunk``.

    ``order_ahead`` is the ordering of the descending pass (default: ``order``
    reversed); it decides which rows at an equal position lie ahead of each other.
    The columns of ``per_key``, one row per key, come along with the carried values (NULL for other keys).
    ``dealt`` says that a join by (keys, chunk) has just dealt the rows, so they are not dealt again.
    """
    keys = list(keys)
    pos = F.struct(*order)
    aggs: dict[str | None, list[Column]] = {}
    carries, outs, locals_back, locals_ahead = [], [], [], []
    fwd = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    local_f = Window.partitionBy(*keys, chunk).orderBy(*order)
    ahead = list(order_ahead) if order_ahead is not None else [F.desc(c) for c in order]
    local_b = Window.partitionBy(*keys, chunk).orderBy(*ahead)
    upto = (Window.unboundedPreceding, 0)
    before = (Window.unboundedPreceding, -1)

    for r in runs:
        s, c, here = f"_s_{r.name}", f"_c_{r.name}", f"_l_{r.name}"
        if r.kind == "sum":
            aggs.setdefault(r.where, []).append(F.sum(r.expr).alias(s))
            carries.append(F.sum(s).over(fwd).alias(c))
            locals_back.append(F.sum(r.expr).over(local_f.rowsBetween(*upto)).alias(here))
            out = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
        elif r.kind == "total":
            aggs.setdefault(r.where, []).append(F.sum(r.expr).alias(s))
            carries.append(F.sum(s).over(Window.partitionBy(*keys)).alias(c))
            out = F.col(c)
        else:
            back = r.kind in BACKWARD
            adjacent = r.kind in ("lag", "lead")
            e = F.struct(r.expr.alias("v")) if adjacent else r.expr
            if r.monotone:
                agg = F.max(e) if back else F.min(e)
            else:
                agg = (F.max_by if back else F.min_by)(e, F.when(e.isNotNull(), pos))
            aggs.setdefault(r.where, []).append(agg.alias(s))
            carries.append(F.last(s, ignorenulls=True).over(fwd if back else bwd).alias(c))
            w = local_f if back else local_b
            frame = upto if r.kind in ("last", "next") else before
            (locals_back if back else locals_ahead).append(F.last(e, ignorenulls=True).over(w.rowsBetween(*frame)).alias(here))
            out = F.coalesce(F.col(here), F.col(c))
            if adjacent:
                out = out.getField("v")
        outs.append((r, out.alias(r.name)))

    summary = df.groupBy(*keys, chunk).agg(*aggs.pop(None, [F.count(F.lit(1)).alias("_rows")]))
    for where, parts in aggs.items():
        summary = summary.unionByName(df.filter(where).groupBy(*keys, chunk).agg(*parts), allowMissingColumns=True)
    if aggs:
        names = [c for c in summary.columns if c.startswith("_s_")]
        summary = summary.groupBy(*keys, chunk).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    carry = summary.select(*keys, chunk, *carries)
    more = [] if per_key is None else [c for c in per_key.columns if c not in keys]
    if per_key is not None:
        carry = carry.join(per_key, keys, "left")
    # Dealt before the windows, so that what they are computed from is not sent along.
    rows = df if dealt else df.repartition(*keys, chunk)
    # The descending pass goes first: its sort should not carry the columns of the other pass.
    for local in (locals_ahead, locals_back):
        rows = rows.select("*", *local) if local else rows
    # Joined last, so no sort holds what is carried; outer, so that only the summaries, never the rows, can become the built side.
    joined = rows.join(carry, [*keys, chunk], "left")
    ordered = [o for r, o in outs if r.kind in AHEAD] + [o for r, o in outs if r.kind not in AHEAD]
    return joined.select(*df.columns, *ordered, *more)


def join_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], chunk: str = CHUNK) -> DataFrame:
    """Attach one row per key to chunked rows without shuffling the rows by key.

    The small table is spread over the key's chunks first, so the rows keep the
    (keys, chunk) partitioning that the running functions use.
    """
    spots = df.select(*keys, chunk).distinct().join(per_key, list(keys))
    return df.join(spots, [*keys, chunk], "left")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk: str = CHUNK) -> DataFrame:
    """0-based position of each row in its key."""
    out = running(df, keys, order, [Run(name, F.lit(1).cast("long"), "sum")], chunk=chunk)
    return out.withColumn(name, F.col(name) - 1)


def row_index_and_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, total: str, chunk: str = CHUNK
) -> DataFrame:
    """0-based position of each row in its key, and the number of rows of the key."""
    one = F.lit(1).cast("long")
    out = running(df, keys, order, [Run(name, one, "sum"), Run(total, one, "total")], chunk=chunk)
    return out.withColumn(name, F.col(name) - 1)


def run_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], label: Column, name: str = "run_id", chunk: str = CHUNK
) -> DataFrame:
    """Number the runs of equal labels (NULL is a label of its own), from 1."""
    keys = list(keys)
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    changed = ~F.col("_label").eqNullSafe(F.lag("_label").over(w))
    local = (
        df.withColumn("_label", label)
        .withColumn("_turn", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(changed.cast("int")))
        .withColumn("_local", F.sum(F.col("_turn").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    pos = F.struct(*order)
    edges = local.groupBy(*keys, chunk).agg(
        F.min_by(F.struct("_label"), pos).alias("_first"),
        F.max_by(F.struct("_label"), pos).alias("_last"),
        F.max("_local").alias("_turns"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    prev = F.lag("_last").over(by_chunk)
    seam = F.when(prev.isNotNull() & ~prev.eqNullSafe(F.col("_first")), 1).otherwise(0)
    edges = edges.withColumn("_step", seam + F.coalesce(F.lag("_turns").over(by_chunk), F.lit(0)))
    offset = edges.select(
        *keys, chunk, F.sum("_step").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("_offset")
    )
    return (
        local.join(offset, [*keys, chunk], "left")
        .withColumn(name, F.col("_local") + F.col("_offset") + 1)
        .select(*df.columns, name)
    )
