"""Packing of token sequences by linear grouping: few rounded sizes, configurations, real pieces, then best fit.

1. A task turns whole texts into ids and cuts those longer than a sequence. Each piece gets its rank among
   the pieces of its length in that task; one row per (task, length) makes it a rank in the corpus.
2. Only the histogram of lengths, one row per length, reaches the driver. There the large lengths, in
   descending order, are cut into groups of equal cardinality; each is rounded up to its group's longest.
   Configurations of these few sizes are found by filling up the largest size left, as often as counts allow.
3. A large piece's rank says its group and place, and one search in the table of configurations its sequence.
4. The room that real lengths leave is summed per sequence; its histogram and that of the small lengths are
   matched by best fit, longest first, by counts; what does not fit opens new sequences.

Nothing that the driver holds grows with the number of documents.

Nulls and edge cases: null and empty texts are the end id alone; null ids are kept; rows with equal doc_id are
packed each on its own; a text of exactly a whole number of sequences has no shorter last piece; an empty
table gives no rows. Only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sleepsignal.llm.common import WordTokens, slices, small_batches, trimmed
from sleepsignal.session import cut

GROUPS = 512
SMALL = 16  # a piece of at most 1/SMALL of a sequence is small

PIECES = "part int, nth long, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids; ``rank`` counts earlier pieces of that length in the task ``part``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        words, seen = WordTokens(tokenizer, 150_000), np.zeros(size + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1_500_000):
                ids, lens = words.encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(lens), end_id).astype("<u4")
                lens = lens + 1
                first = np.cumsum(lens) - lens
                n = -(-lens // size)
                doc = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, lens[doc] - start)
                at = first[doc] + start
                data = [ids[a: a + k].tobytes() for a, k in zip(at, length, strict=True)]
                order = np.argsort(length, kind="stable")
                run = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = run
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                columns = {
                    "part": pa.array(np.full(len(doc), part, np.int32)), "nth": pa.array(nth + np.arange(len(doc))),
                    "doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(length.astype(np.int32)), "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()), "rank": pa.array(rank),
                }
                if with_ids:
                    columns["ids"] = pa.array(data, pa.binary())
                nth += len(doc)
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(make), PIECES + (", ids binary" if with_ids else ""))


def rank_all(rows: DataFrame, value: str) -> DataFrame:
    """Turn the rank inside a task into the rank over all tasks, among rows of equal ``value``."""
    counts = rows.groupBy("part", value).agg((F.max("rank") + 1).alias("_n"))
    before = Window.partitionBy(value).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", value, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # the rows join on (task, value): as many keys as tasks, so no value makes one task large
    return rows.join(counts, ["part", value]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_before")


# -- the plan, on histograms -----------------------------------------------------------------------


def fill(room: int, sizes: np.ndarray, left: np.ndarray) -> list[int]:
    """Groups, with repeats, whose sizes fill ``room`` as far as any choice from what is left can."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    via = np.full(room + 1, -1, np.int32)
    for g in np.flatnonzero((left > 0) & (sizes <= room)):
        s, step = int(sizes[g]), reach.copy()
        for _ in range(min(int(left[g]), room // s)):
            moved = np.zeros_like(step)
            moved[s:] = step[:-s]
            new = moved & ~reach
            if not new.any():
                break
            via[new] = g
            reach |= new
            step = moved
        if reach[room]:
            break
    out, at = [], int(np.flatnonzero(reach)[-1])
    while at:
        out.append(int(via[at]))
        at -= int(sizes[via[at]])
    return out


@dataclass
class LargePlan:
    """Places of large pieces in descending order of length: interval starts, and the sequence of each start."""

    starts: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    sequences: int = 0
    above: np.ndarray | None = None  # large pieces longer than each length


def plan_large(counts: np.ndarray, size: int, small: int, groups: int = GROUPS) -> LargePlan:
    """``counts[length]`` pieces; lengths above ``small`` are large."""
    lengths = np.arange(size, small, -1)
    n = counts[lengths]
    total = int(n.sum())
    above = np.zeros(size + 1, np.int64)
    above[lengths] = np.cumsum(n) - n
    plan = LargePlan(above=above)
    if not total:
        return plan
    each = -(-total // groups)
    starts = np.arange(0, total, each)
    left = np.minimum(each, total - starts)
    ends = np.cumsum(n)
    sizes = lengths[np.searchsorted(ends, starts, side="right")]  # of the first, longest piece of each group
    used = np.zeros(len(starts), np.int64)
    found: list[tuple[int, int]] = []
    while (open_ := np.flatnonzero(left)).size:
        g = int(open_[0])
        left[g] -= 1
        pattern = [g, *fill(size - int(sizes[g]), sizes, left)]
        left[g] += 1
        kinds, times = np.unique(pattern, return_counts=True)
        copies = int((left[kinds] // times).min())
        for k in pattern:
            found.append((int(starts[k] + used[k]), plan.sequences))
            used[k] += copies
            left[k] -= copies
        plan.sequences += copies
    found.sort()
    plan.starts, plan.sequence = [a for a, _ in found], [b for _, b in found]
    return plan


@dataclass
class SmallPlan:
    """Per interval of small pieces: length, first rank, then the room's value, first rank of room, pieces each."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)


def plan_small(counts: np.ndarray, rooms: np.ndarray, size: int, small: int) -> SmallPlan:
    """Best fit, longest first: a piece goes to the fullest sequence that holds it. Room -1: a new sequence.

    Sequences with equal room are alike, so whole intervals of them are filled at once; having taken one
    piece, a sequence that still holds another of that length is the fullest that does.
    """
    held: dict[int, list[tuple[int, int, int]]] = {int(r): [(int(r), 0, int(rooms[r]))] for r in np.flatnonzero(rooms) if r}
    plan, opened = SmallPlan(), 0
    for length in range(small, 0, -1):
        need, done = int(counts[length]), 0
        while done < need:
            room = min((r for r in held if r >= length), default=None)
            if room is None:
                n = -(-(need - done) // (size // length))
                held[size] = [(-1, opened, opened + n)]
                opened += n
                continue
            each = room // length
            kind, lo, hi = held[room].pop()
            take = min(hi - lo, -(-(need - done) // each))
            plan.length.append(length)
            plan.first.append(done)
            plan.room.append(kind)
            plan.at.append(lo)
            plan.each.append(each)
            put = min(take * each, need - done)
            full, part = divmod(put, each)
            done += put
            for left, a, b in ((room - each * length, lo, lo + full), (room - part * length, lo + full, lo + take), (room, lo + take, hi)):
                if b > a and left:
                    held.setdefault(left, []).append((kind, a, b))
            if not held[room]:
                del held[room]
    return plan


# -- Spark -----------------------------------------------------------------------------------------


def histogram(rows: DataFrame, value: str, size: int) -> np.ndarray:
    """Counts of the values 0..size; at most ``size + 1`` rows reach the driver."""
    out = np.zeros(size + 1, np.int64)
    for r in rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r[0]] = r["n"]
    return out


def ranked_in_task(rows: DataFrame, value: str, size: int) -> DataFrame:
    """Add ``part`` and ``rank`` (rows of equal ``value`` before it in the task)."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size + 1, np.int64)
        part = TaskContext.get().partitionId()
        for pdf in batches:
            v = pdf[value].to_numpy()
            yield pdf.assign(part=np.int32(part), rank=pdf.groupby(value).cumcount().to_numpy() + seen[v])
            seen += np.bincount(v, minlength=size + 1)

    return rows.mapInPandas(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, rank long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Pack all ``docs``: per piece its sequence_id and offset there; sequences hold ``size`` ids at most."""
    small_batches(docs.sparkSession)
    small = size // SMALL
    pieces = cut(pieces_of(docs, tokenizer, size, end_id, with_ids))
    counts = histogram(pieces, "length", size)
    large = plan_large(counts, size, small, groups)
    keys = rank_all(pieces.select("part", "nth", "length", "rank"), "length")

    above, starts, sequence = large.above, np.array(large.starts, np.int64), np.array(large.sequence, np.int64)

    @F.pandas_udf("long")
    def large_sequence(length: pd.Series, rank: pd.Series) -> pd.Series:
        place = above[length.to_numpy()] + rank.to_numpy()
        k = np.searchsorted(starts, place, side="right") - 1
        return pd.Series(sequence[k] + place - starts[k])

    big = cut(keys.filter(F.col("length") > small).select("part", "nth", "length", large_sequence("length", "rank").alias("sequence_id")))
    room = big.groupBy("sequence_id").agg((F.lit(size) - F.sum("length")).cast("int").alias("room"))
    room = cut(ranked_in_task(room, "room", size))
    tiny = plan_small(counts, histogram(room, "room", size), size, small)
    length0, first0, room0, at0, each0 = (np.array(x, np.int64) for x in (tiny.length, tiny.first, tiny.room, tiny.at, tiny.each))
    order = np.lexsort((first0, length0))
    code = length0[order] * (1 << 44) + first0[order]

    @F.pandas_udf("room int, at long")
    def small_place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = order[np.searchsorted(code, length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"room": room0[k].astype(np.int32), "at": at0[k] + (rank.to_numpy() - first0[k]) // each0[k]})

    rest = keys.filter(F.col("length") <= small).withColumn("_p", small_place("length", "rank"))
    rest = rest.select("part", "nth", F.col("_p.room").alias("room"), F.col("_p.at").alias("at"))
    spots = rank_all(room, "room").select("room", F.col("rank").alias("at"), "sequence_id")
    joined = rest.filter("room >= 0").join(spots, ["room", "at"]).select("part", "nth", "sequence_id")
    new = rest.filter("room < 0").select("part", "nth", (F.col("at") + large.sequences).alias("sequence_id"))
    where = big.select("part", "nth", "sequence_id").unionByName(joined).unionByName(new)
    by_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(where, ["part", "nth"]).withColumn("offset", F.coalesce(F.sum("length").over(by_sequence), F.lit(0)))
    kept = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"]
    return out.select(*kept, *(["ids"] if with_ids else []))
