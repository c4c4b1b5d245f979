"""Overlapping labelled spans as disjoint ones: at every time the span listed last among the open ones.

Spans are cut at time chunks. Those that cover a whole chunk are reduced to the last listed one by a partial
aggregate; the others meet it in the task of their (session, chunk). There all their edges make elementary
intervals, and a span raises the intervals it covers: it enters a table of powers of two at two places, and the
levels are pushed down once, so n spans take n log n steps however they overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sleepsignal.plans.chunked import CHUNK
from sleepsignal.schemas import KEY, require

NONE = -1


def highest_cover(lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Per interval 0..n-1 the highest ``rank`` of the ranges [lo, hi) that hold it; NONE where there is none."""
    real = hi > lo
    lo, hi, rank = lo[real], hi[real], rank[real]
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table = [np.full(n, NONE, np.int64) for _ in range(int(level.max(initial=0)) + 1)]
    for k, row in enumerate(table):
        some = level == k
        np.maximum.at(row, lo[some], rank[some])
        np.maximum.at(row, hi[some] - (1 << k), rank[some])
    for k in range(len(table) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(table[k - 1], table[k], out=table[k - 1])
        np.maximum(table[k - 1][half:], table[k][:-half], out=table[k - 1][half:])
    return table[0]


def sweep(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the disjoint spans of all groups: ``row`` is the span that is on top."""
    edges = np.unique(np.stack([np.tile(group, 2).astype(np.float64), np.concatenate([lo, hi])], axis=1), axis=0)
    at = edges[:, 0] + 1j * edges[:, 1]  # complex numbers sort by group, then time
    a, b = np.searchsorted(at, group + 1j * lo), np.searchsorted(at, group + 1j * hi)
    by_rank = np.empty(len(rank), np.int64)
    by_rank[rank] = np.arange(len(rank))
    top = highest_cover(a, b, rank, len(edges))
    turn = np.flatnonzero(np.concatenate([[True], (np.diff(top) != 0) | (np.diff(edges[:, 0]) != 0)]))
    stop = np.append(turn[1:], len(top))
    held = top[turn] != NONE
    return by_rank[top[turn[held]]], edges[turn[held], 1], edges[np.minimum(stop[held], len(edges) - 1), 1]


def disjoint_spans(spans: DataFrame, start: str, end: str, label: str, order: str | None = None, chunk_s: float = 3600.0) -> DataFrame:
    """(session, start, end, label): where spans overlap, the one with the highest ``order`` holds.

    Without ``order``, and among equal ones, the later started one holds, then the later ending one, then the
    greater label. A null label holds like any other. Spans without a start or end, and empty ones, are left out.
    Chunk borders may cut a span in two of equal label.
    """
    require(spans, [KEY, start, end, label, *([order] if order else [])])
    pick = lambda c: F.col(c).cast("double")
    listed = pick(order) if order else F.lit(0.0)
    rows = spans.select(KEY, listed.alias("_order"), pick(start).alias("_from"), pick(end).alias("_to"), F.col(label).alias("_label")).filter("_to > _from")
    chunks = F.sequence(F.floor(F.col("_from") / chunk_s).cast("long"), (F.ceil(F.col("_to") / chunk_s) - 1).cast("long"))
    rows = rows.withColumn(CHUNK, F.explode(chunks))
    first, last = F.col(CHUNK) * chunk_s, (F.col(CHUNK) + 1) * chunk_s
    whole = (F.col("_from") <= first) & (F.col("_to") >= last)
    names = ["_order", "_from", "_to", "_label"]
    covering = rows.filter(whole).groupBy(KEY, CHUNK).agg(F.max(F.struct(*names)).alias("_top")).select(KEY, CHUNK, "_top.*")
    parts = covering.unionByName(rows.filter(~whole)).select(
        KEY, CHUNK, *names, F.greatest("_from", first).alias("_lo"), F.least("_to", last).alias("_hi"))
    out = StructType([spans.schema[KEY], StructField(start, DoubleType()), StructField(end, DoubleType()), StructField(label, spans.schema[label].dataType)])

    def cover(table: pa.Table) -> pa.RecordBatch:
        key, chunk = table.column(KEY).combine_chunks(), table.column(CHUNK).to_numpy()
        same = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False) if len(key) > 1 else np.empty(0, bool)
        group = np.concatenate([[0], np.cumsum(~(same.astype(bool) & (np.diff(chunk) == 0)))])
        ordered = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
        rank = np.empty(len(ordered), np.int64)
        rank[ordered] = np.arange(len(ordered))
        row, lo, hi = sweep(group, table.column("_lo").to_numpy(), table.column("_hi").to_numpy(), rank)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([key.take(at), pa.array(lo), pa.array(hi), table.column("_label").combine_chunks().take(at)], [KEY, start, end, label])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, chunk = batch.column(KEY), batch.column(CHUNK).to_numpy()
            ends = (chunk == chunk[-1]) & pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False).astype(bool)
            split = int(np.argmax(ends))  # its last chunk may go on in the next batch
            joins = held and held[0].column(CHUNK)[0].as_py() == chunk[0] and held[0].column(KEY)[0] == keys[0]
            if held and not joins:
                yield cover(pa.Table.from_batches(held))
                held = []
            if split:
                yield cover(pa.Table.from_batches([*held, batch.slice(0, split)]))
                held = []
            held.append(batch.slice(split))
        if held:
            yield cover(pa.Table.from_batches(held))

    return parts.filter(F.col(KEY).isNotNull()).repartition(KEY, CHUNK).sortWithinPartitions(KEY, CHUNK).mapInArrow(make, out)

