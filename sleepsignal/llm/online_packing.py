"""Bounded-space online packing: a fixed number of open windows per task, best fit, the fullest goes first.

1. A task reads its documents in order and keeps at most ``open_windows`` windows of ``size`` ids. Whole windows
   of a long document go out by themselves. What is left of a document goes to the window with the least room
   that holds it. If none does, a new window is opened while there are fewer than ``open_windows``; else the
   fullest window goes out, filled up with the document's first ids, and the rest is placed again. So a window
   that goes out is full, and at most one document is cut for it.
2. Only the windows still open at a task's end hand their ids on. They are merged by their place in one long row
   of leftovers: sums by task, by 1 024 tasks, then over those, give each its place, and the row is cut every
   ``size`` ids. Its end, shorter than a window, is cut at powers of two, which need no padding.

A task holds ``open_windows`` windows and one batch of texts, whatever it reads. No text is shuffled; of a task's
output only the leftovers (at most ``open_windows * size`` ids) are touched again. Placement follows the order of
the file splits, which Spark fixes when it plans the scan, so a task that runs again gives the same rows; the
windows are written before they are read.

Nulls and edge cases: null and empty texts are the end id alone; null ids are kept; rows with equal doc_id are
packed each on its own; a document of exactly a whole number of windows has no shorter piece; equal room goes to
the window opened first; texts of any length are read whole; an empty table gives no rows. Only doc_id and text are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sleepsignal.llm.common import WordTokens, slices
from sleepsignal.session import cut

SIZE = 4096
OPEN_WINDOWS = 16
BLOCK = 1024  # tasks summed together
WORDS = 300_000  # distinct words whose ids a task remembers

PIECES = "part int, left int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
FIELDS = [f.split() for f in PIECES.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


@contextmanager
def batch_bytes(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Hand texts to Python in batches of ``size`` while the block runs, then as the session had it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@dataclass
class Open:
    """A window that can still take ids: its number, how many it holds, and its pieces."""

    number: int
    held: int = 0
    pieces: list[tuple] = field(default_factory=list)


class Packer:
    """One task's windows. ``add`` gives the pieces of every window that goes out; ``leftovers`` what stays open."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most = size, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending
        self.open: dict[int, Open] = {}
        self.opened = 0

    def _new(self) -> Open:
        w = Open(self.opened)
        self.opened += 1
        return w

    def _put(self, w: Open, doc: tuple, start: int, ids: bytes) -> list[tuple]:
        """Add a piece; the window's pieces if that fills it."""
        n = len(ids) // 4
        w.pieces.append((*doc, start, n, zlib.crc32(ids), w.number, w.held, ids))
        w.held += n
        if w.held == self.size:
            return w.pieces
        insort(self.rooms, (self.size - w.held, w.number))
        self.open[w.number] = w
        return []

    def _take(self, at: int) -> Open:
        _, number = self.rooms.pop(at)
        return self.open.pop(number)

    def add(self, doc: tuple, ids: bytes) -> Iterator[tuple]:
        """Place a document, ``ids`` as little-endian unsigned 32-bit integers; ``doc`` is carried to its pieces."""
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            yield from self._put(self._new(), doc, at, ids[4 * at: 4 * (at + self.size)])
            at += self.size
        while at < total:
            left = total - at
            best = bisect_left(self.rooms, (left, -1))
            if best < len(self.rooms):
                w, n = self._take(best), left
            elif len(self.rooms) < self.most:
                w, n = self._new(), left
            else:
                w = self._take(0)
                n = self.size - w.held
            yield from self._put(w, doc, at, ids[4 * at: 4 * (at + n)])
            at += n

    def leftovers(self) -> Iterator[tuple[int, list[tuple]]]:
        for number in sorted(self.open):
            yield number, self.open[number].pieces


def packed(docs: DataFrame, tokenizer: str, size: int, end_id: int, open_windows: int) -> DataFrame:
    """Pieces of all windows; ``left`` numbers those still open at the task's end, whose pieces carry their ids."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, packer = WordTokens(tokenizer, WORDS), Packer(size, open_windows)
        first = part << 32
        for whole in batches:
            for batch in slices(whole, "text", 1_500_000):
                ids, lens = words.encode(batch.column("text"))
                ends = np.cumsum(lens)
                rows = []
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), (ends - lens).tolist(), ends.tolist(), strict=True):
                    data = ids[a:b].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                    for d, tokens, start, n, crc, number, offset, _ in packer.add((doc_id, b - a + 1), data):
                        rows.append((part, None, d, start, n, crc, tokens, first + number, offset, None))
                if rows:
                    yield batch_of(rows)
        for number, pieces in packer.leftovers():
            yield batch_of([(part, number, d, start, n, crc, tokens, None, offset, ids) for d, tokens, start, n, crc, _, offset, ids in pieces])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, PIECES)


def places(windows: DataFrame) -> DataFrame:
    """Where each open window (part, left, fill) starts in the row of leftovers, in order of task and number."""
    before = (Window.unboundedPreceding, -1)
    in_task = Window.partitionBy("part").orderBy("left").rowsBetween(*before)
    in_block = Window.partitionBy("_block").orderBy("part").rowsBetween(*before)
    over_blocks = Window.orderBy("_block").rowsBetween(*before)  # one row per 1 024 tasks
    tasks = windows.groupBy("part").agg(F.sum("fill").alias("_fill")).withColumn("_block", F.floor(F.col("part") / BLOCK))
    blocks = tasks.groupBy("_block").agg(F.sum("_fill").alias("_fill")).select("_block", F.sum("_fill").over(over_blocks).alias("_far"))
    tasks = tasks.withColumn("_near", F.sum("_fill").over(in_block)).join(blocks, "_block").select("part", "_near", "_far")
    none = F.lit(0)
    windows = windows.withColumn("_here", F.sum("fill").over(in_task)).join(tasks, "part")
    return windows.select("part", "left", (F.coalesce("_far", none) + F.coalesce("_near", none) + F.coalesce("_here", none)).alias("place"))


def tail_cuts(total: int, size: int) -> list[int]:
    """Places where the end of the row, shorter than a window, is cut: into powers of two, largest first."""
    at, out = total - total % size, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return [*out, total]


def merged(left: DataFrame, total: int, size: int) -> DataFrame:
    """Pieces of leftovers with their ``place`` in the row, cut into sequences of ``size`` ids (numbered -1, -2, ...)."""
    whole, cuts = total - total % size, tail_cuts(total, size)

    def sequence(at: int) -> tuple[int, int, int]:
        """Number, first place and end of the sequence that holds ``at``."""
        if at < whole:
            k = at // size
            return k, k * size, (k + 1) * size
        k = int(np.searchsorted(cuts, at, side="right")) - 1
        return whole // size + k, cuts[k], cuts[k + 1]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, tokens, place, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "place", "ids")], strict=True):
                done, n = 0, len(ids) // 4
                while done < n:
                    k, lo, hi = sequence(place + done)
                    take = min(n - done, hi - place - done)
                    rows.append((doc_id, start + done, take, zlib.crc32(ids[4 * done: 4 * (done + take)]), tokens, -1 - k, place + done - lo))
                    done += take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return left.select("doc_id", "start", "doc_tokens", "place", "ids").mapInArrow(make, ", ".join(f"{n} long" for n in names))


def pack_online(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 2, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``size`` ids; per piece its sequence_id and offset there.

    Every sequence is full but those of the end of the leftovers, whose lengths are distinct powers of two (if ``size`` is one).
    """
    if size < 1 or open_windows < 1:
        raise ValueError("a window holds at least one id, and at least one is open")
    with batch_bytes(docs.sparkSession):
        pieces = cut(packed(docs, tokenizer, size, end_id, open_windows))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = pieces.filter("left IS NOT NULL")
    windows = cut(left.groupBy("part", "left").agg(F.sum("length").alias("fill")))
    total = windows.agg(F.sum("fill")).first()[0] or 0
    spots = left.join(places(windows), ["part", "left"]).withColumn("place", F.col("place") + F.col("offset"))
    return pieces.filter("left IS NULL").select(*kept).unionByName(merged(spots, total, size))
