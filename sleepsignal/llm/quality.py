"""Text quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Each labelled document is one online step. Per feature, z gathers gradients and n their squares; its weight is
0 while |z| is within l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2), so the model stays sparse.
Features are words, pairs of words, marks, shapes and shares of repeats (``ngrams.Grams``), each present or
not. Scoring sums the weights of the features a whole text has. Documents pass in the order of their id's
hash, again and again for ``steps`` steps; the sample is bounded by ``rows`` documents.

Nulls and edge cases: null and empty texts get the score of their share features and the bias; without labels
every score is 0.5; a null doc_id belongs to the held-out fold; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.ngrams import Linear, Sample, collect_features, sample_labelled, with_score

ROWS = 8_000
STEPS = 24_000
HELD_OUT, FOLDS = 0, 5
THRESHOLD = 0.3


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, alpha: float = 0.15, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, least: int = 2) -> Linear:
    """FTRL-proximal over the rows in their order; each row holds the distinct features of a document.

    Features of fewer than ``least`` documents are left out."""
    s = Sample(rows, least)
    features = s.features
    z, n = np.zeros(len(features) + 1), np.zeros(len(features) + 1)  # the last is the bias, without l1
    places = [np.append(s.column[a:b], len(features)) for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]

    def weight(at: np.ndarray) -> np.ndarray:
        free = np.where(at == len(features), 0.0, l1)
        zi = z[at]
        return np.where(np.abs(zi) <= free, 0.0, -(zi - np.sign(zi) * free) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for step in range(steps if places else 0):
        at, y = places[step % len(places)], labels[step % len(places)]
        w = weight(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - y
        g /= np.sqrt(len(at))
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
        z[at] += g - sigma * w
        n[at] += g * g
    w = weight(np.arange(len(features) + 1))
    used = np.flatnonzero(w[:-1])
    return Linear(features[used], w[used], w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Linear:
    sample = sample_labelled(docs, labels, "quality", HELD_OUT, FOLDS, rows)
    key = F.shiftleft(F.xxhash64("doc_id"), 1).bitwiseOR(F.col("label").cast("long")).alias("key")  # order, and the label in the last bit
    keys, feats = collect_features(sample.select("text", key), "key", marks=True)
    order = np.argsort(keys, kind="stable")
    return fit_ftrl([feats[i] for i in order], keys[order] & 1)


def score_quality(docs: DataFrame, labels: DataFrame, name: str = "quality_score", **sample: int) -> DataFrame:
    """``docs`` with the score in [0, 1] as column ``name``."""
    return with_score(docs, train(docs, labels, **sample), name, marks=True)
