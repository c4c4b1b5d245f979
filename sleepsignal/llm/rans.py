"""Token ids of a corpus in range-coded files (static rANS), read back in parallel.

A file holds the documents of one range of ids, in ascending order of doc_id (nulls first, equal ids by
text). Its ids are cut into blocks of ``LANES * STEPS`` ids. All blocks share the file's frequency table;
each is coded on its own by ``LANES`` interleaved coders that write to one stream of 32-bit words. Every
``CHECK`` steps the coder states and the place in the stream are kept, so that decoding can start there.

Layout, little-endian::

    magic | blocks | footer (zlib) | length of the footer (u64) | crc32 of the footer (u32) | magic
    block: states at the checkpoints (u64, checkpoint by lane) | words (u32)

The footer has the frequency table, one entry per block (place, ids, words, crc32 of the ids, words before
each checkpoint) and one per document (doc_id, ids).

Nulls and edge cases: a null or empty text is the end id alone; a null doc_id is kept and sorts first; rows
with equal doc_id are documents of their own; an empty table gives no file and no row; only doc_id and text
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sleepsignal.llm.common import WordTokens, open_fs, shared_folder, slices, small_batches, trimmed, write_file
from sleepsignal.session import cut

MAGIC = b"IDSRANS1"
LANES, STEPS, CHECK = 128, 512, 128
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
SHARD_IDS = 2_000_000
TOGETHER = 8  # blocks coded side by side
SPLIT_BLOCKS = 16  # blocks per reading task

SHARDS = "part int, seq int, file string, n_docs long, n_ids long, n_blocks int"
IDS = "doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary"


# -- the coder -------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Scale counts to a sum of 2**bits; every symbol that occurs keeps at least 1."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    total = 1 << bits
    f = np.maximum(1, counts[seen] * total // counts.sum())
    over = int(f.sum()) - total
    if over <= 0:
        f[np.argmax(counts[seen])] -= over
    else:
        for i in np.argsort(-f):
            take = min(over, int(f[i]) // 2)
            f[i] -= take
            over -= take
            if not over:
                break
    out[seen] = f
    return out


class Table:
    """Frequencies with what both directions look up."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code ``ids`` [blocks, steps, lanes]; per block its checkpoint states, words before each, and words."""
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words = np.empty((steps, blocks, lanes), np.uint32)
    wrote = np.empty((steps, blocks, lanes), bool)
    states = np.empty((blocks, -(-steps // CHECK), lanes), np.uint64)
    top = np.uint64(63) - table.bits
    for s in range(steps - 1, -1, -1):
        sym = ids[:, s]
        f = table.freq[sym]
        full = x >= (f << top)
        words[s], wrote[s] = x.astype(np.uint32), full
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << table.bits) + (x - q * f) + table.start[sym]
        if s % CHECK == 0:
            states[:, s // CHECK] = x
    out = []
    for b in range(blocks):
        before = np.concatenate([[0], np.cumsum(wrote[:, b].sum(axis=1))])[:steps:CHECK]
        out.append((states[b], before.astype(np.uint32), words[:, b][wrote[:, b]]))
    return out


def decode_blocks(states: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids [blocks, steps, lanes] from states [blocks, lanes] and each block's place in ``words``."""
    x, at = states.copy(), at.astype(np.int64)
    out = np.empty((len(x), steps, x.shape[1]), np.int32)
    mask = (np.uint64(1) << table.bits) - np.uint64(1)
    for s in range(steps):
        slot = x & mask
        sym = table.symbol[slot]
        out[:, s] = sym
        x = table.freq[sym] * (x >> table.bits) + slot - table.start[sym]
        need = x < LOW
        nth = np.cumsum(need, axis=1)
        x[need] = (x[need] << WORD) | words.take((at[:, None] + nth - 1)[need], mode="clip")
        at += nth[:, -1]
    return out


# -- files -----------------------------------------------------------------------------------------


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, lens: np.ndarray, n_symbols: int, pad: int) -> Iterator[bytes]:
    """The bytes of one file. ``pad`` fills the last block up to whole steps."""
    counts = np.bincount(ids, minlength=n_symbols)
    bits = max(20, int(n_symbols).bit_length() + 4)
    freq = frequencies(counts, bits)
    table = Table(freq, bits)
    size = LANES * STEPS
    yield MAGIC
    place, index, before = len(MAGIC), [], []
    n_full = len(ids) // size
    groups = [ids[a * size: min(a + TOGETHER, n_full) * size].reshape(-1, STEPS, LANES) for a in range(0, n_full, TOGETHER)]
    tail = ids[n_full * size:]
    if len(tail):
        steps = -(-len(tail) // LANES)
        groups.append(np.concatenate([tail, np.full(steps * LANES - len(tail), pad, tail.dtype)]).reshape(1, steps, LANES))
    done = 0
    for group in groups:
        for states, words_before, words in encode_blocks(group, table):
            n = min(group.shape[1] * LANES, len(ids) - done)
            index.append((place, n, len(words), zlib.crc32(ids[done: done + n].astype("<u4").tobytes())))
            before.append(words_before)
            data = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            place, done = place + len(data), done + n
            yield data
    seen = np.flatnonzero(freq)
    parts = [
        seen.astype("<u4"), freq[seen].astype("<u4"), np.array(index, "<u8").reshape(-1, 4),
        np.concatenate(before).astype("<u4") if before else np.empty(0, "<u4"),
        doc_ids.astype("<i8"), valid.astype("u1"), lens.astype("<u8"),
    ]
    head = json.dumps({"bits": bits, "symbols": n_symbols, "lanes": LANES, "steps": STEPS, "check": CHECK, "sizes": [p.size for p in parts]}).encode()
    footer = zlib.compress(struct.pack("<I", len(head)) + head + b"".join(p.tobytes() for p in parts), 6)
    yield footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC


class Shard:
    """One open file: its footer, and ids of any range."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(20, size - 20)
        length, crc = struct.unpack("<QI", tail[:12])
        footer = self.file.read_at(length, size - 20 - length)
        if tail[12:] != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{uri}: damaged footer")
        raw = zlib.decompress(footer)
        n = struct.unpack_from("<I", raw)[0]
        self.head, at, parts = json.loads(raw[4: 4 + n]), 4 + n, []
        for kind, count in zip(("<u4", "<u4", "<u8", "<u4", "<i8", "u1", "<u8"), self.head["sizes"], strict=True):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        seen, f, index, self.before, self.doc_ids, self.valid, self.lens = parts
        self.index = index.reshape(-1, 4).astype(np.int64)
        freq = np.zeros(self.head["symbols"], np.int64)
        freq[seen] = f
        self.table = Table(freq, self.head["bits"])
        self.uri, self.block = uri, self.head["lanes"] * self.head["steps"]
        self.ends = np.cumsum(self.lens.astype(np.int64))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``; blocks read whole are checked against their checksum."""
        if start >= end:
            return np.empty(0, np.int32)
        first, last = start // self.block, (end - 1) // self.block
        out, b = [], first
        while b <= last:
            lo = start - b * self.block if b == first else 0
            if lo or self.index[b, 1] < self.block:
                out.append(self._one(b, lo, min(end - b * self.block, int(self.index[b, 1]))))
                b += 1
            else:
                group = [k for k in range(b, min(b + TOGETHER, last + 1)) if self.index[k, 1] == self.block]
                out.append(self._whole(group))
                b += len(group)
        return np.concatenate(out)[: end - start]

    def _load(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, n, n_words, _ = self.index[b]
        lanes, check = self.head["lanes"], self.head["check"]
        points = -(-(-(-int(n) // lanes)) // check)
        raw = self.file.read_at(int(points * lanes * 8 + n_words * 4), int(place))
        states = np.frombuffer(raw, "<u8", points * lanes).reshape(points, lanes)
        per_block = -(-self.head["steps"] // check)
        return states, self.before[b * per_block: b * per_block + points], np.frombuffer(raw, "<u4", int(n_words), points * lanes * 8)

    def _one(self, b: int, lo: int, hi: int) -> np.ndarray:
        """Part of a block, from the last checkpoint at or before ``lo``."""
        states, before, words = self._load(b)
        lanes, check = self.head["lanes"], self.head["check"]
        point = lo // lanes // check
        steps = -(-hi // lanes) - point * check
        got = decode_blocks(states[point: point + 1], words, before[point: point + 1], steps, self.table).reshape(-1)
        if lo == 0 and hi == self.index[b, 1]:
            self._verify(b, got[:hi])
        return got[lo - point * check * lanes: hi - point * check * lanes]

    def _whole(self, group: list[int]) -> np.ndarray:
        loaded = [self._load(b) for b in group]
        words = np.concatenate([w for _, _, w in loaded])
        at = np.cumsum([0] + [len(w) for _, _, w in loaded[:-1]])
        got = decode_blocks(np.stack([s[0] for s, _, _ in loaded]), words, at, self.head["steps"], self.table)
        for b, ids in zip(group, got, strict=True):
            self._verify(b, ids.reshape(-1))
        return got.reshape(-1)

    def _verify(self, b: int, ids: np.ndarray) -> None:
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.index[b, 3]:
            raise ValueError(f"{self.uri}: block {b} does not match its checksum")


# -- Spark -----------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files of ``folder``; one row per file, in the order of doc_id.

    Rows are dealt by ranges of doc_id, so tasks hold a bounded share; a task writes a file whenever it has
    ``shard_ids`` ids. File names follow from the task, and a file appears only once it is whole.
    """
    spark = docs.sparkSession
    small_batches(spark, "6m")  # larger batches have fewer distinct words in all
    folder = folder or shared_folder(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        words = WordTokens(tokenizer, 400_000)
        n_symbols = max(words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([h[1] for h in held])
            keys = [k for h in held for k in h[2]]
            name = f"part-{part:06d}-{seq:05d}.ids"
            valid = np.array([k is not None for k in keys], np.uint8)
            write_file(folder, name, shard_bytes(ids, np.array([k or 0 for k in keys], np.int64), valid, lens, n_symbols, end_id))
            blocks = -(-len(ids) // (LANES * STEPS))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [f"{folder}/{name}"],
                "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "n_blocks": pa.array([blocks], pa.int32()),
            })

        for whole in batches:
            for batch in slices(whole, "text", 6_000_000):
                ids, lens = words.encode(batch.column("text"))
                # the end id goes behind each document
                out = np.insert(ids, np.cumsum(lens), end_id).astype(np.int32)
                held.append((out, lens + 1, batch.column("doc_id").to_pylist()))
                if sum(len(h[0]) for h in held) >= shard_ids:
                    yield flush()
                    held, seq = [], seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(ordered.mapInArrow(trimmed(write), SHARDS))


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each file: totals per writing task, one window over those, then one inside each task."""
    tasks = shards.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    return shards.join(tasks, "part").withColumn("shard_start", F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("_before")


def read_ids(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files that ``write_ids`` lists: doc_id, start (ids before it), n_tokens, ids_crc32.

    A task takes ``SPLIT_BLOCKS`` blocks and owns the documents that start in them; it starts decoding at the
    last checkpoint before its first one. ``with_ids`` adds the ids as little-endian 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                starts = shard.ends - shard.lens.astype(np.int64)
                lo, hi = np.searchsorted(starts, [row["split"] * SPLIT_BLOCKS * shard.block, (row["split"] + 1) * SPLIT_BLOCKS * shard.block])
                while lo < hi:  # a slice of documents at a time, so that no more than about a million ids, or one document's, are held
                    to = min(hi, max(lo + 1, int(np.searchsorted(shard.ends, starts[lo] + 1_000_000))))
                    ids = shard.ids(int(starts[lo]), int(shard.ends[to - 1])).astype("<u4")
                    docs = [ids[a:b].tobytes() for a, b in zip(starts[lo:to] - starts[lo], shard.ends[lo:to] - starts[lo], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.doc_ids[lo:to], pa.int64(), mask=shard.valid[lo:to] == 0),
                        "local_start": pa.array(starts[lo:to] + row["shard_start"], pa.int64()),
                        "n_tokens": pa.array(shard.lens[lo:to].astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                        "ids": pa.array(docs if with_ids else [None] * (to - lo), pa.binary()),
                    })
                    lo = to

    splits = shard_starts(shards).select("file", "shard_start", F.explode(F.sequence(F.lit(0), ((F.col("n_blocks") - 1) / SPLIT_BLOCKS).cast("int"))).alias("split"))
    n = max(1, min(100_000, splits.count()))
    out = splits.repartition(n, "file", "split").mapInArrow(trimmed(read), IDS).withColumnRenamed("local_start", "start")
    return out if with_ids else out.drop("ids")


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(write_ids(docs, tokenizer, end_id))
