"""What the operators share: words as hashes, token ids by word, files in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleepsignal.session import checkpoint_dir

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for one run's files, in the folder that the driver and all executors share; always a URI."""
    base = checkpoint_dir(spark).rstrip("/")
    if "://" not in base:
        base = "file:///" + base.removeprefix("file:").lstrip("/")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain ``file:/a/b``, as Spark prints it, is understood too."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: Iterable[bytes]) -> int:
    """Write under a name of its own, then move: a retried or doubled task never leaves a half file. Returns bytes."""
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    tmp, size = f"{root}/_{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(tmp) as out:
        for part in data:
            size += len(part)
            out.write(part)
    fs.move(tmp, f"{root}/{name}")
    return size


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash. The table only saves time: it is emptied at ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(column: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case, split at white space) in a row, and the number of words of each text."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = real.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    coded = flat.filter(real).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return known.of(distinct)[coded.indices.to_numpy(zero_copy_only=False)], np.bincount(doc[kept], minlength=len(counts))


def runs(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches ``pool[start: start + len]`` in a row."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - ends + lens, lens)]


class Numbers(dict):
    """Word to its number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordTokens:
    """Token ids of whole texts; each distinct word passes the tokenizer once.

    The tokenizer splits at white space, looks at nothing beyond it and ignores case, so a text's ids are
    those of its words; a test holds this against whole-text encoding. A new word of small Latin letters, with
    marks behind it or none, needs no normalising and goes straight to the tokenizer's model. Other new words
    are encoded together, a control character between them; words that hold it go by themselves. Once the
    table has ``limit`` words, rare ones are dropped between batches.
    """

    SEPARATOR = "\x01"
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
    LETTERS = "[a-zß-öø-ÿ]"

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [c for c in map(chr, range(0x61, 0x100)) if re.fullmatch(self.LETTERS, c)]
        self.bytes_of = {ord(c): "".join(t for t, _ in split(c)) for c in letters}
        self.limit = limit
        self.separator = self._encode([self.SEPARATOR])[0]
        self.index = Numbers()
        self.pool, self.starts, self.lens, self.hits = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the words met most often, up to half of the limit; drop those met once."""
        half = self.limit // 2
        least = max(2, int(np.sort(self.hits)[-half])) if len(self.hits) > half else 2
        keep = np.flatnonzero(self.hits >= least)[:half]
        words = list(self.index)
        self.index = Numbers(zip((words[i] for i in keep.tolist()), range(len(keep)), strict=True))
        self.pool = runs(self.pool, self.starts[keep], self.lens[keep])
        self.lens = self.lens[keep]
        self.starts, self.hits = np.cumsum(self.lens) - self.lens, np.zeros(len(keep), np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if any(self.SEPARATOR in w for w in words) or len(self.separator) != 1:
            found = self._encode(words)
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)
        ids = np.array(self._encode([f" {self.SEPARATOR} ".join(words)])[0], np.int32)
        at = np.concatenate([[-1], np.flatnonzero(ids == self.separator[0]), [len(ids)]])
        return ids[ids != self.separator[0]], np.diff(at) - 1

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of small Latin letters."""
        tokenize, table = self.model.tokenize, self.bytes_of
        ids = [[t.id for t in tokenize(w if w.isascii() else w.translate(table))] for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def _learn(self, words: list[str]) -> None:
        """Fill in the ids of the words last numbered. Words that end in marks are made from what is in front."""
        first = len(self.lens)
        column = pa.array(words, pa.string())
        stems = pc.ascii_rtrim(column, characters=self.MARKS)
        simple = pc.match_substring_regex(stems, f"^{self.LETTERS}+$").to_numpy(zero_copy_only=False)
        bare = pc.equal(pc.binary_length(column), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(simple & ~bare)
        fronts = stems.take(pa.array(marked)).to_pylist()
        front = np.fromiter(map(self.index.__getitem__, fronts), np.int64, len(fronts))
        extra = list(islice(self.index, first + len(words), None))
        self.starts = np.concatenate([self.starts, np.zeros(len(words) + len(extra), np.int64)])
        self.lens = np.concatenate([self.lens, np.zeros(len(words) + len(extra), np.int64)])
        self.hits = np.concatenate([self.hits, np.zeros(len(words) + len(extra), np.int64)])

        def put(at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
            self.starts[first + at], self.lens[first + at] = len(self.pool) + np.cumsum(lens) - lens, lens
            self.pool = np.concatenate([self.pool, ids])

        plain = np.flatnonzero(simple & bare)
        put(np.concatenate([plain, len(words) + np.arange(len(extra))]), *self._plain([words[i] for i in plain.tolist()] + extra))
        other = np.flatnonzero(~simple)
        for a in range(0, len(other), 4096):
            put(other[a: a + 4096], *self._together([words[i] for i in other[a: a + 4096].tolist()]))
        tails = Numbers()
        tail = np.fromiter((tails[words[i][len(f):]] for i, f in zip(marked.tolist(), fronts, strict=True)), np.int64, len(marked))
        mark_ids = self._encode(list(tails))
        mark_lens = np.fromiter(map(len, mark_ids), np.int64, len(mark_ids))
        pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(mark_ids), np.int32, int(mark_lens.sum()))])
        two_starts = np.stack([self.starts[front], len(self.pool) + (np.cumsum(mark_lens) - mark_lens)[tail]], axis=1).reshape(-1)
        two_lens = np.stack([self.lens[front], mark_lens[tail]], axis=1)
        put(marked, runs(pool, two_starts, two_lens.reshape(-1)), two_lens.sum(axis=1))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text (0 for null and empty ones)."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if not len(column):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self.index) > self.limit:
            self._forget()
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # else a special token in capitals would become one
            column = pc.ascii_lower(column)
        words = pc.ascii_split_whitespace(column)
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        if len(self.index) > len(self.lens):
            self._learn(list(islice(self.index, len(self.lens), None)))
        self.hits[number] += 1
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.lens[at]
        bounds = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return runs(self.pool, self.starts[at], lens), np.diff(bounds)


def trimmed(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``make`` as it is, but a task hands back the memory it has freed, as Python workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if give_back is not None:
                give_back(0)

    return run


def slices(batch: pa.RecordBatch, text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``chars`` characters at most, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // chars
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Spark hand texts to Python in batches of a few megabytes, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of rounds that are over; else they stay until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(id_column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


BITMAP_BITS = 1 << 26
PROBES = 3


def place_in_bitmap(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(13 * probe)) & np.uint64(bits - 1)).astype(np.int64)


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits set for 64-bit ``column``, as bytes; at most ``bits / 64`` rows reach the driver, whatever the input."""
    places = F.array(*[F.shiftrightunsigned(column, 13 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)])
    rows = hashes.select(F.explode(places).alias("at"))
    rows = rows.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bit"))
    got = rows.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy()
    return out.view(np.uint8)


def in_bitmap(h: np.ndarray, table: np.ndarray, probe: int) -> np.ndarray:
    at = place_in_bitmap(h, probe, len(table) * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_be_in(docs: DataFrame, hashed: Column, keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``hashed`` value may be among ``column`` of ``keys``: all that are, and few others; and the rest.

    The bitmap has a fixed size, so it can be broadcast for any number of keys; a join has to follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys, column, bits))

    @F.arrow_udf("boolean")
    def known(h: pa.Array) -> pa.Array:
        x = h.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(np.logical_and.reduce([in_bitmap(x, shared.value, k) for k in range(PROBES)]))

    return docs.filter(known(hashed)), docs.filter(~known(hashed))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    longest = max(map(len, taken), default=0)
    return [n if n.lower() not in taken else n + "_" * (longest + 1 - len(n)) for n in names]


def text_key() -> list[Column]:
    """128 bits that follow from the text alone, as columns ``_k1`` and ``_k2``; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("_k1"), F.xxhash64(F.lit(2), text).alias("_k2")]


def unit(c: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1 << 30)) / F.lit(float(1 << 30))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
