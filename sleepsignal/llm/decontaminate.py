"""Benchmark decontamination with spaced seeds.

A text overlaps an item if, laid side by side without gaps at any shift, some stretch of at least ``MIN_OVERLAP``
words (the whole item, if that is shorter) has at least 3/4 equal words; the longest such stretch is reported.

A seed is six words at the places of a fixed mask inside a window of 7 to 12, so an item whose words were partly
replaced still shares seeds with its source. The eight masks meet every overlap of items of 12 words and more: a
stretch of 26 words and more has a half that is an overlap too, so those of 12 to 25 words are enough, and
each of these holds 12, 16, 20 or 24 words in a row of which at most a quarter differ; the masks were searched so that
all such patterns hold a seed, and tests go through them. Seeds of the benchmark and of the training texts are
joined on their hashes. Before that, a bitmap of fixed size over the benchmark's seeds, three bits each, leaves out
nearly all training seeds where they are made; it only saves work, the join decides. Each hit gives an alignment of
a stretch of text with an item. The stretch reaches as far around its seeds as the longest item is long, so every
alignment is compared over the whole item.

Items of 5 to 11 words are searched as they are, unmasked; items of less than 5 words are not searched.

Nulls and edge cases: words are lower-case, without marks around them, and marks alone are no words; null and
empty texts have none and are clean; null or empty items match nothing; equal items count as the one with the
smallest item_id; equal texts share their result, so repeated rows are all found; a null doc_id is kept; an
empty benchmark leaves every document clean. Only doc_id and text, item_id and text are read; other columns stay
as they are, whatever their names. A text of any length costs its words once, and what surrounds its seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import BITMAP_BITS, MIX_A, PROBES, WordHashes, bitmap_of, free_names, in_bitmap, mix, slices, small_batches, text_key, trimmed, word_hashes
from sleepsignal.session import cut

#: 1 is compared, 0 ignored. Together they meet every accepted pattern of equal words.
MASKS = (
    "1011111",
    "1111011",
    "11101011",
    "110011011",
    "1101000111",
    "10100100111",
    "11011000101",
    "111000010011",
)
SPAN = max(map(len, MASKS))  # items of at least this many words are searched by the masks
SHORTEST = 5
MIN_OVERLAP = 13
EQUAL = 3, 4  # equal words of an overlap, as a fraction
SALTS = 8


class Bare(WordHashes):
    """Hashes of words without the marks around them; 0 for marks alone."""

    def __missing__(self, word: str) -> int:
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        if b - a == len(word):
            return super().__missing__(word)
        h = self[word[a:b]] if b > a else 0
        self[word] = h
        return h


def words_of(column: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(column, known)
    real = words != 0
    doc = np.repeat(np.arange(len(counts)), counts)
    return words[real], np.bincount(doc[real], minlength=len(counts))


def masks_for(short: list[int]) -> list[np.ndarray]:
    """Compared positions of each mask; whole windows for the lengths of short items."""
    return [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS] + [np.arange(n) for n in short]


def seeds(words: np.ndarray, counts: np.ndarray, mask: np.ndarray, span: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at every place from which ``span`` words of the same text follow, and these places."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
    at = np.flatnonzero(left >= span)
    if not len(at):
        return np.empty(0, np.uint64), at
    size = len(words) - span + 1
    h = np.full(size, np.uint64(number + 1))
    for k, p in enumerate(mask.tolist()):
        factor = (int(MIX_A) * (2 * k + 3)) & ((1 << 64) - 1) | 1
        h += (words[p: p + size] ^ np.uint64(k)) * np.uint64(factor)
    return mix(h[at] * MIX_A), at


def mask_number(length: int, short: list[int]) -> list[int]:
    """Masks that an item of ``length`` words is searched by."""
    return list(range(len(MASKS))) if length >= SPAN else [len(MASKS) + short.index(length)]


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """Distinct items of at least ``SHORTEST`` words: item_id, words (64-bit hashes), n."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bare()
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = words_of(batch.column("text"), known)
                ends = np.cumsum(counts)
                data = [words[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(data, pa.binary()), pa.array(counts.astype(np.int32))], ["item_id", "words", "n"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(make, "item_id long, words binary, n int").filter(F.col("n") >= SHORTEST)
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.max("n").alias("n"))


def benchmark_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """hash, item_id and place of every seed of the items."""
    masks = masks_for(short)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, data in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.frombuffer(data, np.uint64)
                for number in mask_number(len(words), short):
                    h, at = seeds(words, np.array([len(words)]), masks[number], int(masks[number][-1]) + 1, number)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item_id] * len(h), pa.int64()), pa.array(at.astype(np.int32))], ["hash", "item_id", "place"])

    return items.mapInArrow(make, "hash long, item_id long, place int")


STRETCH = "_k1 long, _k2 long, stretch int, words binary, hits array<struct<place:int,hash:long>>"


def stretches(docs: DataFrame, short: list[int], bitmap: np.ndarray, reach: int) -> DataFrame:
    """Stretches of text around seeds that the bitmap lets through: text key, number, words, hits in the stretch.

    ``reach`` words before and after a seed belong to it, so that an item that holds the seed fits in.
    """
    masks = masks_for(short)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)  # its size is fixed by the parameter

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Bare(150_000), shared.value
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                words, counts = words_of(batch.column("text"), known)
                hits, places = [], []
                for number, mask in enumerate(masks):
                    h, at = seeds(words, counts, mask, int(mask[-1]) + 1, number)
                    for k in range(PROBES):  # each probe only for what the last let through
                        inside = in_bitmap(h, table, k)
                        h, at = h[inside], at[inside]
                    hits.append(h)
                    places.append(at)
                h, at = np.concatenate(hits), np.concatenate(places)
                if not len(h):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order].view(np.int64), at[order]
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                cuts = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > 2 * reach)) + 1, [len(at)]])
                k1, k2 = batch.column("_k1").to_numpy(), batch.column("_k2").to_numpy()
                rows, number, last = [], 0, -1
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    d = int(doc[a])
                    number = number + 1 if d == last else 0
                    last = d
                    lo = max(int(ends[d] - counts[d]), int(at[a]) - reach)
                    hi = min(int(ends[d]), int(at[b - 1]) + reach)
                    found = [{"place": int(p) - lo, "hash": int(x)} for p, x in zip(at[a:b], h[a:b], strict=True)]
                    rows.append({"_k1": int(k1[d]), "_k2": int(k2[d]), "stretch": number, "words": words[lo:hi].tobytes(), "hits": found})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("_k1", pa.int64()), ("_k2", pa.int64()), ("stretch", pa.int32()), ("words", pa.binary()),
                    ("hits", pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())])))]))

    return docs.select(*text_key(), F.col("text").cast("string")).mapInArrow(trimmed(make), STRETCH)


def longest_overlap(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch with the share ``EQUAL`` of equal words, the first of several."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, EQUAL[1], 0) - EQUAL[0])])
    # a stretch counts if its end is not lower than its start: from each start to the last end that is high enough
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    ends = len(total) - np.searchsorted(ahead[::-1], total, side="left") - 1
    start = int(np.argmax(ends - np.arange(len(total))))
    return start, int(ends[start])


def overlaps(docs: DataFrame, benchmark: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Verified overlaps: text key (_k1, _k2), item_id, n_words, n_equal."""
    small_batches(docs.sparkSession)
    items = cut(benchmark_words(benchmark))
    short = sorted(r["n"] for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect())  # SPAN - SHORTEST values
    reach = items.agg(F.max("n")).first()[0] or 0
    found = cut(benchmark_seeds(items, short))
    around = cut(stretches(docs, short, bitmap_of(found, "hash", bits), reach).dropDuplicates(["_k1", "_k2", "stretch"]))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("_k1"), F.lit(SALTS)).cast("int").alias("salt")
    key = ["_k1", "_k2", "stretch"]
    hits = around.select(*key, salt, F.explode("hits").alias("hit")).select(*key, "salt", F.col("hit.hash").alias("hash"), F.col("hit.place").alias("at"))
    met = hits.join(found.select("*", salts), ["hash", "salt"])
    lines = met.select(*key, "salt", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = lines.join(items.select("item_id", F.col("words").alias("item"), "n", salts), ["item_id", "salt"])
    beside = F.substring("words", F.greatest("shift", F.lit(0)) * 8 + 1, (F.col("n") + F.least("shift", F.lit(0))) * 8)
    pairs = pairs.join(around.select(*key, "words"), key).withColumn("words", beside).withColumn("skipped", F.greatest(-F.col("shift"), F.lit(0)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item"], np.uint64)
                least = min(MIN_OVERLAP, len(item))
                item = item[r["skipped"]: r["skipped"] + len(text)]
                equal = text[: len(item)] == item
                a, b = longest_overlap(equal)
                if b - a >= least:
                    rows.append((r["_k1"], r["_k2"], r["item_id"], b - a, int(equal[a:b].sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["_k1", "_k2", "item_id", "n_words", "n_equal"])

    return pairs.select("_k1", "_k2", "item_id", "skipped", "words", "item").mapInArrow(compare, "_k1 long, _k2 long, item_id long, n_words long, n_equal long")


def leaked_texts(docs: DataFrame, benchmark: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per leaking text: its key, n_items, n_words and n_equal of the longest overlap, the smallest item_id."""
    best = F.max(F.struct("n_words", "n_equal"))
    found = overlaps(docs, benchmark, bits).groupBy("_k1", "_k2").agg(
        F.countDistinct("item_id").cast("int").alias("n_items"), F.min("item_id").alias("item_id"), best.alias("_best"))
    return cut(found.select("_k1", "_k2", "n_items", "item_id", "_best.n_words", "_best.n_equal"))


def contamination(docs: DataFrame, benchmark: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, first_item, overlap_words, equal_words."""
    leaked = leaked_texts(docs, benchmark, bits).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select("doc_id", *text_key(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    out = rows.join(leaked, ["_k1", "_k2", "_salt"], "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("item_id").alias("first_item"), F.coalesce("n_words", F.lit(0)).alias("overlap_words"), F.coalesce("n_equal", F.lit(0)).alias("equal_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; all columns stay."""
    l1, l2 = free_names(docs, "_l1", "_l2")
    leaked = leaked_texts(docs, benchmark, bits).select(F.col("_k1").alias(l1), F.col("_k2").alias(l2))
    k1, k2 = text_key()
    return docs.join(leaked, (k1 == F.col(l1)) & (k2 == F.col(l2)), "left_anti")
