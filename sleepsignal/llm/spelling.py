"""Spelling variants: words one inserted, deleted or replaced code point apart, by dense prefix-suffix tiles.

1. Words are counted over whole texts with built-in functions and partial aggregation.
2. Words are dealt to groups so that every near pair meets. A near pair has a shorter word of L code points (or
   two of L) and is equal outside one place, so with h = L // 2 it agrees on the first h or on the last L - h
   code points. A group is (L, agreed first p, agreed last s); it holds words of L and of L + 1.
3. A group of more than ``LARGE`` words is halved again in the part not yet agreed, and so on until one code
   point is open. Then it holds no more words of L than there are letters, and of L + 1 than their square. So
   groups are bounded by the alphabet, and nothing is dropped; the number of rounds follows the logarithm of the longest word.
4. Groups of like size are stacked into padded code-point matrices, left- and right-aligned, and blocks of words of
   L are compared with blocks of words of L and L + 1: the first place where two rows differ is the common prefix,
   the last the common suffix. Their sum reaches the longer length minus one exactly for single edits.
   Large groups are compared block by block, so a tile's memory is fixed.
5. A pair may meet in several groups and counts in the first: in the half that agrees on the prefix if it can, in
   the other only if the prefix is too short (``below``). Groups hand on per word how many near words and the
   best of them; sums and maxima per word follow. Forms are followed to their roots by doubling.

Group keys are 64-bit hashes; a collision merges two groups and costs time, as every pair is checked against
its own group's bounds.

Nulls and edge cases: null and empty texts have no words; a null doc_id counts as the empty text in the hash that
deletes a code point; rows with equal doc_id are counted each; repeated rows count as often as they stand; texts and words of any length are taken whole; ties
for the form go to the smallest word in code-point order; an empty table gives no rows. Only doc_id and text are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleepsignal.session import cut

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
DELETE_EVERY = 199
RUN = "([A-Za-zÀ-ÿ]+)"
LARGE = 256
CELLS = 4_000_000  # code points compared at once
BLOCK = 64  # words on a side of a tile of a large group


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs, some with one code point deleted by a hash of document and run."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1))).alias("_r"))
    runs = runs.select("_d", lower_ascii(F.col("_r")).alias("_r")).filter(F.char_length("_r") >= least_length)
    runs = runs.withColumn("_h", F.crc32(F.concat("_d", F.lit(":"), "_r").cast("binary")))
    at = (F.col("_h") % F.char_length("_r")).cast("int")
    cutout = F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.char_length("_r")))
    words = runs.select(F.when(F.col("_h") % DELETE_EVERY == 0, cutout).otherwise(F.col("_r")).alias("word"))
    counted = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


# -- groups ----------------------------------------------------------------------------------------

BOUNDS = ["size", "p", "s", "below"]


def child(size: Column, p: Column, s: Column, below: Column) -> Column:
    """One group of a word: the words of ``size`` (and one more) that share p first and s last code points."""
    w = F.col("word")
    key = F.xxhash64(size, p, s, below, F.substring(w, F.lit(1), p), F.substring(w, F.char_length(w) - s + 1, s))
    return F.struct(key.alias("key"), size.alias("size"), p.alias("p"), s.alias("s"), below.alias("below"))


def halves(size: Column, p: Column, s: Column, below: Column) -> list[Column]:
    """The two groups that hold all near pairs of (size, p, s): agreeing on more in front, or on more behind."""
    open_ = size - p - s
    half = F.floor(open_ / 2).cast("int")
    return [child(size, p + half, s, below), child(size, p, s + open_ - half, F.least(below, p + half))]


def first_groups(words: DataFrame) -> DataFrame:
    """Each word in the groups of its own length, and as the longer word in those of one less."""
    none, n = F.lit(0), F.char_length("word")
    every = [g for size in (n, n - 1) for g in halves(size, none, none, size + 1)]
    return words.withColumn("_g", F.explode(F.array(*every))).select("word", "n", "_g.*")


def split_groups(words: DataFrame, large: int = LARGE) -> DataFrame:
    """Groups of at most ``large`` words, or with a single code point open: (word, n, key, size, p, s, below)."""
    rows, done = cut(first_groups(words)), []
    while True:
        # a group without a word of ``size`` has no pair to find
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.char_length("word") - F.col("size")).alias("_least"))
        counts = cut(counts.filter("_n > 1 AND _least = 0").select("key", "_n"))
        wide = rows.filter("size - p - s > 1").join(counts.filter(F.col("_n") > large).select("key"), "key")
        wide = cut(wide.select("word", "n", F.explode(F.array(*halves(*[F.col(b) for b in BOUNDS]))).alias("_g")).select("word", "n", "_g.*"))
        kept = rows.join(counts, "key").filter((F.col("_n") <= large) | F.expr("size - p - s <= 1"))
        done.append(kept.withColumn("_n", F.col("_n").cast("int")).select("word", "n", "key", *BOUNDS, "_n"))
        if wide.isEmpty():
            break
        rows = wide
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# -- tiles -----------------------------------------------------------------------------------------


def matrix(words: list[str], width: int, from_end: bool) -> np.ndarray:
    """Code points, one row per word, padded with zeros behind (or, read from the end, in front of the word)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(w[::-1] if from_end else w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), width), np.uint8 if codes.max(initial=0) < 256 else np.uint32)
    out[np.arange(width) < lens[:, None]] = codes
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` (.., x, 1, width) with every row of ``b`` (.., 1, y, width)."""
    differ = a != b
    return np.where(differ.any(axis=-1), differ.argmax(axis=-1), a.shape[-1])


def tile(front: np.ndarray, back: np.ndarray, lens: np.ndarray, bounds: np.ndarray, x: slice, y: slice) -> np.ndarray:
    """Which words of block ``x`` (of the group's length) are near which of block ``y``; first axis: groups."""
    size, p, s, below = (bounds[:, k, None, None] for k in range(4))
    lx, ly = lens[:, x, None], lens[:, None, y]
    prefix = np.minimum(common(front[:, x, None], front[:, None, y]), np.minimum(lx, ly))
    suffix = np.minimum(common(back[:, x, None], back[:, None, y]), np.minimum(lx, ly))
    real = (lx == size) & ((ly == size) | (ly == size + 1))
    met = (prefix >= p) & (suffix >= s) & (prefix < below)
    same = (lx == ly) & (prefix >= lx)
    return real & met & ~same & (prefix + suffix >= ly - 1)


class Best:
    """Per word of a stack of groups: near words so far, and the best of them."""

    def __init__(self, n: np.ndarray, order: np.ndarray):
        self.n, self.order = n, order  # order: place of the word among the batch's words in code-point order
        self.near = np.zeros(n.shape, np.int64)
        self.top = np.full(n.shape, -1, np.int64)

    def add(self, hit: np.ndarray, x: slice, y: slice) -> None:
        """``hit[g, i, j]``: word i of block x is near word j of block y, and the other way round."""
        self._side(hit, x, y)
        self._side(hit.transpose(0, 2, 1), y, x)

    def _side(self, hit: np.ndarray, x: slice, y: slice) -> None:
        self.near[:, x] += hit.sum(axis=2)
        g, i, j = np.nonzero(hit)
        if not len(g):
            return
        i, j = i + (x.start or 0), j + (y.start or 0)
        o = np.lexsort((self.order[g, j], -self.n[g, j], i, g))
        g, i, j = g[o], i[o], j[o]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(i) != 0)]))
        g, i, j = g[first], i[first], j[first]
        was = self.top[g, i]
        old = np.maximum(was, 0)
        better = (was < 0) | (self.n[g, j] > self.n[g, old]) | ((self.n[g, j] == self.n[g, old]) & (self.order[g, j] < self.order[g, old]))
        self.top[g[better], i[better]] = j[better]


def compare(words: list[str], n: np.ndarray, starts: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near words per row in its group: rows with any, how many, and the row of the best."""
    order = np.empty(len(words), np.int64)
    order[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    found = []
    shape = 1 << np.ceil(np.log2(np.maximum(counts, 2))).astype(np.int64)
    width = bounds[:, 0] + 1
    wide = 8 * -(-width // 8)
    for kind in np.unique(np.stack([shape, wide], axis=1), axis=0):
        rows_each, w = int(kind[0]), int(kind[1])
        members = np.flatnonzero((shape == rows_each) & (wide == w))
        block = min(rows_each, BLOCK)
        block = max(1, min(block, int((CELLS // w) ** 0.5)))
        stack = max(1, CELLS // (block * block * w))
        held = max(1, CELLS // (rows_each * w))
        for a in range(0, len(members), min(stack, held)):
            some = members[a: a + min(stack, held)]
            at = starts[some, None] + np.minimum(np.arange(rows_each), counts[some, None] - 1)
            there = np.arange(rows_each) < counts[some, None]
            flat = [words[i] for i in at.reshape(-1).tolist()]
            front = matrix(flat, w, False).reshape(len(some), rows_each, w)
            back = matrix(flat, w, True).reshape(len(some), rows_each, w)
            own = np.where(there, lens[at], -9)
            best = Best(n[at], order[at])
            for i in range(0, rows_each, block):
                x = slice(i, min(i + block, rows_each))
                if not (own[:, x] == bounds[some, 0, None]).any():
                    continue
                for j in range(0, rows_each, block):
                    y = slice(j, min(j + block, rows_each))
                    hit = tile(front, back, own, bounds[some], x, y)
                    even = own[:, x, None] == own[:, None, y]  # two words of one length meet twice: take them once
                    best.add(hit & (~even | (np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop))), x, y)
            g, i = np.nonzero(best.near)
            found.append((at[g, i], best.near[g, i], at[g, best.top[g, i]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def near_in_groups(groups: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) once per word and group that holds a near word."""
    names = ["word", "n_near", "form_n", "form"]

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([table.column(c).to_numpy() for c in ("key", *BOUNDS)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(axis=1)]))
        counts = np.diff(np.append(starts, len(key)))
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        rows, near, best = compare(words, n, starts, counts, key[starts, 1:])
        if len(rows):
            column = table.column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays([column.take(pa.array(rows)), pa.array(near), pa.array(n[best]), column.take(pa.array(best))], names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # its last group may go on in the next batch
            if last:
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[0].column("key")[0].as_py() != key[0]:
                yield from emit(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from emit(pa.Table.from_batches(held))

    dealt = groups.repartition("key").sortWithinPartitions("key", *BOUNDS, F.char_length("word"))  # words of the group's length first
    return dealt.select("word", "n", "key", *BOUNDS).mapInArrow(make, "word string, n_near long, form_n long, form string")


# -- forms and roots -------------------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms followed to the last, by doubling.

    Counts grow by the ratio at each step, so a chain has few steps and none comes back.
    """
    hops = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = hops.select(F.col("word").alias("_w"), F.col("root").alias("_far"))
        longer = cut(hops.join(on, hops["root"] == on["_w"], "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_went")))
        if longer.filter("_went").isEmpty():
            return hops
        hops = longer.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, large: int = LARGE) -> DataFrame:
    """Words (word, n), distinct, with form, root, n_near and form_n."""
    words = cut(words.select("word", "n"))
    found = near_in_groups(split_groups(words, large))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("_best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.form").alias("form"), (-F.col("_best.minus")).alias("form_n"))
    chosen = F.col("form_n") >= ratio * F.col("n")
    out = cut(out.select("word", "n", "n_near", F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n")))
    roots = roots_of(out.filter("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
