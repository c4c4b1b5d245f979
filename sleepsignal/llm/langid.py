"""Language identification with hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of +1 and -1 that follows from its code point. A
trigram's vector binds its letters, each permuted by its place: shift the first by two, the second by one, and
multiply all three. A text's vector bundles (adds) those of its trigrams; a language's prototype bundles its
training texts. The prediction is the language whose prototype has the largest cosine with the text.

Bundling is linear, so training only needs trigram counts per language: they are summed by Spark, and a few
thousand rows a language reach the driver. Texts are taken whole. Learning uses about ``learn`` documents.

Nulls and edge cases: null texts and texts without a letter are ``und`` with score 0; null languages teach
nothing; ties go to the first language by name; a table without a learnable row gives ``und`` everywhere;
repeated rows are predicted alike.

A cosine of few trigrams lies within the noise of the vectors, so ``known`` says exactly what share of a text's
trigrams was met in the texts learned from: 0 for a script that no learned language has, however short the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import fold, slices, small_batches, trimmed, unit

DIMENSIONS = 1024
LEARN = 20_000
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"
BITS = 21


@cache
def letters() -> np.ndarray:
    """Code point to that of its small letter; 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.int32)


class Vectors:
    """Random vectors of letters, made when a letter is met first."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def of(self, points: np.ndarray) -> np.ndarray:
        for p in points.tolist():
            if p not in self.known:
                self.known[p] = np.random.default_rng([17, p]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return np.stack([self.known[p] for p in points.tolist()])

    def bind(self, first: np.ndarray, second: np.ndarray, third: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """Vectors of trigrams given by places in ``alphabet``."""
        v = self.of(alphabet)
        return np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per trigram inside a word: its text, and its places in the alphabet [n, 3]; then the alphabet."""
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    letter = letters()[points]
    keep = letter != 0
    keep[1:] |= letter[:-1] != 0
    keep[0] = True
    keep[:-1] |= letter[1:] != 0
    letter, doc = letter[keep], doc[keep]
    alphabet, place = np.unique(letter, return_inverse=True) if len(letter) < 64 else by_table(letter)
    inside = (letter[1:-1] != 0) & (doc[:-2] == doc[2:])
    at = np.flatnonzero(inside)
    return doc[at + 1], np.stack([place[at], place[at + 1], place[at + 2]], axis=1), alphabet


def by_table(letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(0x110000, bool)
    seen[letter] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    return alphabet, number[letter]


def distinct(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the place of each code among them."""
    if top > 1 << 22:
        return np.unique(code, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[code] = True
    found = np.flatnonzero(seen)
    number = np.zeros(top, np.int32)
    number[found] = np.arange(len(found))
    return found, number[code]


def packed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """One number per trigram of code points."""
    return (first.astype(np.int64) << 2 * BITS) | (second.astype(np.int64) << BITS) | third.astype(np.int64)


def bundle(texts: list[str | None], vectors: Vectors, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors [texts, dimensions] of whole texts, zero for those without a letter; share of trigrams among sorted ``met``."""
    out, share = np.zeros((len(texts), vectors.dimensions), np.float32), np.zeros(len(texts))
    doc, places, alphabet = trigrams(texts)
    if not len(doc):
        return out, share
    n = len(alphabet)
    code, column = distinct((places[:, 0].astype(np.int64) * n + places[:, 1]) * n + places[:, 2], n**3)
    triple = code // (n * n), code // n % n, code % n
    bound = vectors.bind(*triple, alphabet).astype(np.float32)
    known = np.zeros(len(code), bool)
    if met is not None and len(met):
        number = packed(*(alphabet[t] for t in triple))
        known = met[np.minimum(np.searchsorted(met, number), len(met) - 1)] == number
    total = np.bincount(doc, minlength=len(texts))
    share = np.bincount(doc, weights=known[column], minlength=len(texts)) / np.maximum(total, 1)
    step = max(1, 4_000_000 // len(code))
    for a in range(0, len(texts), step):
        lo, hi = np.searchsorted(doc, [a, min(a + step, len(texts))])
        rows = min(step, len(texts) - a)
        counts = np.bincount((doc[lo:hi] - a).astype(np.int64) * len(code) + column[lo:hi], minlength=rows * len(code))
        out[a: a + rows] = counts.reshape(rows, len(code)).astype(np.float32) @ bound
    return out, share


def learn_profiles(docs: DataFrame, learn: int = LEARN, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order of name, their prototypes of length 1, and all trigrams met, from about ``learn`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                langs = batch.column("lang").to_pylist()
                names = sorted(set(langs))
                doc, places, alphabet = trigrams(batch.column("text").to_pylist())
                if not len(doc):
                    continue
                n = len(alphabet)
                lang = np.array([names.index(x) for x in langs])[doc]
                code = ((lang * n + places[:, 0]) * n + places[:, 1]) * n + places[:, 2]
                found, times = np.unique(code, return_counts=True)
                points = alphabet.astype(np.int64)
                number = packed(points[found // (n * n) % n], points[found // n % n], points[found % n])
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in found // n**3]), pa.array(number), pa.array(times.astype(np.int64))], ["lang", "trigram", "n"])

    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    n = max(1, rows.count())
    chosen = rows.filter(unit(F.col("doc_id"), 23) < learn / n).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    got = chosen.mapInArrow(trimmed(count), "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    vectors, out = Vectors(dimensions), np.zeros((len(names), dimensions))
    trigram, times, lang = got.column("trigram").to_numpy(), got.column("n").to_numpy(), np.array(got.column("lang").to_pylist())
    for i, name in enumerate(names):
        for a in range(0, len(t := trigram[lang == name]), 8192):
            part = np.stack([t[a: a + 8192] >> 2 * BITS, (t[a: a + 8192] >> BITS) & ((1 << BITS) - 1), t[a: a + 8192] & ((1 << BITS) - 1)])
            alphabet, place = np.unique(part, return_inverse=True)
            place = place.reshape(part.shape)
            out[i] += times[lang == name][a: a + 8192] @ vectors.bind(*place, alphabet).astype(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.where(norm == 0, 1, norm), np.unique(trigram)


def with_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, met: np.ndarray, column: str = "language") -> DataFrame:
    """Add a struct ``column`` of lang_pred, score (the cosine, at least 0) and known (share of trigrams met while learning)."""
    profiles = prototypes.T.astype(np.float32)

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors(prototypes.shape[1])
        for texts in batches:
            langs, scores, shares = [], [], []
            for part in slices(pa.record_batch({"text": texts}), "text", 1_000_000):
                bundles, share = bundle(part.column(0).to_pylist(), vectors, met)
                shares.append(share)
                norm = np.linalg.norm(bundles, axis=1)
                if not len(names):
                    norm[:] = 0
                cosine = bundles @ profiles / np.where(norm == 0, 1, norm)[:, None] if len(names) else np.zeros((len(norm), 1))
                best = cosine.argmax(axis=1)
                langs += [names[b] if x else UNKNOWN for b, x in zip(best, norm, strict=True)]
                scores.append(np.where(norm == 0, 0.0, np.clip(cosine.max(axis=1), 0, 1)).astype(np.float64))
            numbers = [pa.array(np.concatenate(x) if x else np.empty(0)) for x in (scores, shares)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), *numbers], ["lang_pred", "score", "known"])

    @F.arrow_udf("lang_pred string, score double, known double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(make)(batches)

    small_batches(docs.sparkSession)
    return docs.withColumn(column, predict(F.col("text").cast("string")))


def identify(docs: DataFrame, column: str = "language", learn: int = LEARN, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from ``docs`` (text, lang, doc_id) and predict every one of them."""
    return with_language(docs, *learn_profiles(docs, learn, dimensions), column)
