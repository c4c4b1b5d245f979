"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used to fit the weights. With the class prior p, the
risk of calling unlabelled text clean is corrected by what the toxic share in it must cost:

    risk = p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

When the bracket falls below zero, the step goes up its gradient instead, so that the model cannot gain by
learning the positive examples by heart. g is linear in the presence of hashed words and pairs of words, l the
logistic loss; an L1 step keeps only words that matter. The prior is the toxic share among labelled rows
outside the held-out fold. The sample is bounded by ``positives`` and ``unlabelled`` documents.

Nulls and edge cases: null and empty texts have no feature and get the score of the bias; without a labelled
positive every score is the prior; a null doc_id belongs to the held-out fold; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.llm.common import fold, unit
from sleepsignal.llm.ngrams import Linear, Sample, among, collect_features, sample_labelled, with_score

POSITIVES, UNLABELLED = 2000, 4000
HELD_OUT, FOLDS = 0, 5
THRESHOLD = 0.5
LIFT, SIGMAS, LEAST = 2.0, 5.0, 3


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 200, step: float = 0.3, l1: float = 1e-4) -> Linear:
    """Weights by full-batch adaptive steps on the non-negative risk, with an L1 proximal step.

    Only features that are clearly more common among the positive examples than in unlabelled text take part:
    ``LIFT`` times as common, by ``SIGMAS`` standard errors. Words of a language, as common in both, would else
    swing with every step.
    """
    s = Sample([*positive, *unlabelled], least=2)
    n_pos, n_unl = max(1, len(positive)), max(1, len(unlabelled))
    prior = float(np.clip(prior, 1e-3, 0.999))
    with_pos = np.bincount(s.column[s.row < len(positive)], minlength=len(s.features)) / n_pos
    with_unl = np.bincount(s.column[s.row >= len(positive)], minlength=len(s.features)) / n_unl
    floor = np.maximum(with_unl, 3 / n_unl)
    used = (with_pos >= LIFT * floor) & (with_pos - with_unl >= SIGMAS * np.sqrt(floor / n_pos))
    number, kept = np.cumsum(used) - 1, used[s.column]
    column, row, features = number[s.column[kept]], s.row[kept], s.features[used]
    m = len(features)
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    square, square_b = np.full(m, 1e-8), 1e-8
    is_pos = np.arange(s.n) < len(positive)
    for _ in range(rounds):
        g = b + np.bincount(row, w[column], s.n)
        p = sigmoid(g)
        as_clean = np.logaddexp(0, g)  # loss of calling it clean
        bracket = as_clean[~is_pos].sum() / n_unl - prior * as_clean[is_pos].sum() / n_pos
        up = np.where(is_pos, -prior * p / n_pos, p / n_unl)
        grad = up + np.where(is_pos, -prior * (1 - p) / n_pos, 0.0) if bracket >= 0 else -up
        dw, db = np.bincount(column, grad[row], m), grad.sum()
        square += dw * dw
        square_b += db * db
        rate = step / np.sqrt(square)
        w -= rate * dw
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        b -= step * db / np.sqrt(square_b)
    left = np.flatnonzero(w)
    return Linear(features[left], w[left], b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """Fit on at most ``positives`` confirmed toxic and about ``unlabelled`` other documents."""
    learn = labels.filter(F.col("toxic").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    known, toxic = learn.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("int"))).first()
    prior = (toxic or 0) / known if known else 0.0
    if not toxic:
        return Linear(np.empty(0, np.uint64), np.empty(0), float(np.log(max(prior, 1e-3))))
    pos = sample_labelled(docs, learn.filter(F.col("toxic") == 1), "toxic", HELD_OUT, FOLDS, positives).select("text", F.lit(1).alias("kind"))
    rows = docs.filter(fold("doc_id", FOLDS) != HELD_OUT)
    n = max(1, rows.count())
    unl = rows.filter(unit(F.col("doc_id"), 11) < unlabelled / n).select("text", F.lit(0).alias("kind")).limit(2 * unlabelled)
    toxic_rows = collect_features(pos, "kind")[1]
    # only what at least three positive examples have can take part, so nothing else is gathered from unlabelled text
    frequent = Sample(toxic_rows, least=LEAST).features
    toxic_rows = [f[among(f, frequent)] for f in toxic_rows]
    return fit_nnpu(toxic_rows, collect_features(unl, "kind", only=frequent)[1], prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxicity", **sample: int) -> DataFrame:
    """``docs`` with the score in [0, 1] as column ``name``."""
    return with_score(docs, train(docs, labels, **sample), name)
