"""Hashed word n-grams of whole texts as sparse binary vectors, and samples of labelled documents to learn from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import MIX_A, WordHashes, fold, mix, slices, small_batches, trimmed, unit

TOKEN = re.compile(r"\w+|[^\w\s]+")
WORDS = re.compile(r"\w+")
#: First parts of hashes that are no word's: a word's shape, a pair of shapes, a share.
SHAPE, SHARE = mix(np.array([0x51AFE, 0x5AA7E], np.uint64))
STEMS = (4, 5)
LOWER, CAPITAL, UPPER, NUMBER, MARKS = range(5)


class Shapes(dict):
    """Token to its shape."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        if token.isalpha():
            shape = UPPER if token.isupper() and len(token) > 1 else CAPITAL if token[0].isupper() else LOWER
        else:
            shape = MARKS if not token[0].isalnum() else NUMBER
        self[token] = shape
        return shape


class Grams:
    """Features of texts as 64-bit hashes: words and pairs of words; with ``marks`` also marks, shapes and repeats.

    Without ``marks`` and with ``stems``, longer words also give their first four and five letters, so that
    inflected forms meet.

    With ``marks``, runs of marks are tokens, pairs of shapes are features, and so are the shares (in eighths) of
    capital words, of marks, of tokens that repeat the one before, and of distinct words among all.
    """

    def __init__(self, marks: bool = False, stems: bool = True):
        self.marks, self.stems, self.words, self.shapes = marks, stems, WordHashes(150_000), Shapes()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features, each with the index of its text; a feature may come more than once."""
        pattern = TOKEN if self.marks else WORDS
        tokens = [pattern.findall(t if self.marks else t.lower()) if t else [] for t in texts]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = [w for t in tokens for w in t]
        del tokens
        doc = np.repeat(np.arange(len(counts)), counts)
        raw = self.words.of([w.lower() for w in flat] if self.marks else flat)
        same = doc[:-1] == doc[1:]
        pairs = mix(raw[:-1] * MIX_A + raw[1:])[same]
        feats, docs = [raw, pairs], [doc, doc[:-1][same]]
        if not self.marks:
            for k in STEMS if self.stems else ():
                long_ = np.fromiter(map(len, flat), np.int64, len(flat)) > k
                feats.append(self.words.of([f"{w[:k]}-" for w in flat if len(w) > k]))
                docs.append(doc[long_])
        else:
            shape = np.fromiter(map(self.shapes.__getitem__, flat), np.int64, len(flat))
            feats.append(mix(SHAPE + (shape[:-1] * 8 + shape[1:]).astype(np.uint64))[same])
            docs.append(doc[:-1][same])
            n, size = np.maximum(counts, 1), len(counts)
            key = np.unique(doc.astype(np.uint64) * MIX_A ^ (raw >> np.uint64(1)), return_index=True)[1]
            again = doc[1:][same & (raw[:-1] == raw[1:])]
            for kind, rows in enumerate((doc[shape == UPPER], doc[shape == MARKS], again, doc[key])):
                share = np.bincount(rows, minlength=size) * 8 // n
                feats.append(mix(SHARE + np.uint64(kind * 16) + share.astype(np.uint64)))
                docs.append(np.arange(size))
        return np.concatenate(feats), np.concatenate(docs)


class Linear:
    """A sparse linear model over hashed features: the sum of the weights of the features a text has."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], float(bias)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scores(self, feats: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if not len(self.features):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        near = self.near[(feats & np.uint64(0xFFFF)).astype(np.int64)]
        feats, doc = feats[near], doc[near]
        k = np.minimum(np.searchsorted(self.features, feats), len(self.features) - 1)
        hit = self.features[k] == feats
        pair = np.unique(doc[hit] * len(self.features) + k[hit])
        z = self.bias + np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def with_score(docs: DataFrame, model: Linear, name: str, marks: bool = False) -> DataFrame:
    """Add the model's score of each whole text as column ``name``; only the text goes through Python."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(marks)
        for column in batches:
            out = []
            for part in slices(pa.record_batch({"text": column}), "text", 1_000_000):
                feats, doc = grams.of(part.column(0).to_pylist())
                out.append(model.scores(feats, doc, part.num_rows))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(make)(batches)

    small_batches(docs.sparkSession)
    return docs.withColumn(name, score(F.col("text").cast("string")))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known``, which is ascending."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def features_of(docs: DataFrame, keep: list[str], marks: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """Columns ``keep`` and the distinct features of each text as 64-bit numbers; of ``only`` (ascending), if given."""
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(marks)
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                feats, doc = grams.of(batch.column("text").to_pylist())
                if only is not None:
                    known = among(feats, only)
                    feats, doc = feats[known], doc[known]
                order = np.argsort(doc, kind="stable")
                rows = [np.unique(x).tobytes() for x in np.split(feats[order], np.searchsorted(doc[order], np.arange(1, batch.num_rows)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], [*keep, "features"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(trimmed(make), f"{kinds}, features binary")


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: int, folds: int, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, by smallest hash of their id: doc_id, label, text.

    Null labels and ids are left out; several labels of one id count as their largest. The ids, ``rows`` at
    most, are broadcast, so that the texts are not shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(unit(F.col("_id"), seed), "_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")


def collect_features(sample: DataFrame, keep: str, marks: bool = False, only: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Column ``keep`` and the features of a bounded sample, on the driver and without copies of the features."""
    got = features_of(sample, [keep], marks, only).toArrow()
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("features")]
    return got.column(keep).to_numpy(), rows


class Sample:
    """A bounded sample as compressed rows over the features that at least ``least`` of its documents have.

    Features are first counted by their last 22 bits, and only what can reach ``least`` is put together.
    """

    BITS = np.uint64((1 << 22) - 1)

    def __init__(self, rows: list[np.ndarray], least: int):
        table = np.zeros(int(self.BITS) + 1, np.int32)
        for a in range(0, len(rows), 500):
            table += np.bincount((np.concatenate(rows[a: a + 500]) & self.BITS).astype(np.int64), minlength=len(table)).astype(np.int32)
        rows = [r[table[(r & self.BITS).astype(np.int64)] >= least] for r in rows]
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        found, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        kept = times >= least
        number = np.cumsum(kept) - 1
        row = np.repeat(np.arange(len(rows)), lens)
        use = kept[column]
        self.features, self.column, self.row, self.n = found[kept], number[column[use]], row[use], len(rows)
        self.starts = np.searchsorted(self.row, np.arange(self.n + 1))
