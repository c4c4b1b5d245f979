"""Classifiers, language profiles and licences: held-out accuracy, formulas against plain loops, awkward rows."""

import random
import zlib

import numpy as np
import pytest
import tables

from sleepsignal.llm import langid, license, ngrams, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(n=400):
    """Documents of which every fourth has rude words, every fifth is shouted; labels for most."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = tables.words(rng, "en", rng.randint(20, 120))
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["grumbish", "grumbash", "vile"]))
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        docs.append((i, text, "en", "s", 1, "x", 1, None, 0.5, 7))
        labels.append((i, int(not junk), int(toxic), "no text"))
    labels += [(None, 1, 1, None), (3, None, None, None), (5, 1, None, None), (labels[0][0], 1, 1, None)]
    return docs, labels


def held_out(i, folds=5):
    return zlib.crc32(str(i).encode()) % folds == 0


@pytest.mark.parametrize("module,run,label", [(toxicity, toxicity.score_toxicity, 2), (quality, quality.score_quality, 1)])
def test_held_out_accuracy_and_awkward_rows(spark, module, run, label):
    data, labels = labelled()
    odd = [r for r in tables.rows() if r[0] is None or not (r[1] or "").strip()]
    docs, known = spark.createDataFrame(data + odd, tables.DOCS), spark.createDataFrame(labels, LABELS)
    got = run(docs, known, "_s")
    assert got.columns == [*docs.columns, "_s"]
    rows = got.collect()
    assert len(rows) == len(data) + len(odd) and all(0 <= r["_s"] <= 1 for r in rows)
    want = {r[0]: r[label] for r in labels[:400]}
    held = [(r["_s"] >= module.THRESHOLD) == bool(want[r["doc_id"]]) for r in rows if r["doc_id"] in want and held_out(r["doc_id"]) and r["score"] == 0.5 and r["lang"] == "en" and r["source"] == "s"]
    assert len(held) > 50 and np.mean(held) >= 0.97


@pytest.mark.parametrize("run", [toxicity.score_toxicity, quality.score_quality])
def test_no_rows_and_no_labels(spark, docs, none, run):
    empty = spark.createDataFrame([], LABELS)
    assert run(none, empty, "_s").collect() == []
    scores = {r["_s"] for r in run(docs, empty, "_s").collect()}
    assert len(scores) == 1 and 0 <= min(scores) <= 0.5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    data, labels = labelled(200)
    docs = spark.createDataFrame(data, tables.DOCS)
    turned = [(i, 1 - q, 1 - t, x) if i is not None and q is not None and t is not None and held_out(i) else (i, q, t, x) for i, q, t, x in labels]
    for run in (toxicity.score_toxicity, quality.score_quality):
        a, b = (dict(run(docs, spark.createDataFrame(s, LABELS), "_s").select("doc_id", "_s").collect()) for s in (labels, turned))
        assert a == b


def test_linear_scores_against_a_plain_sum():
    grams, texts = ngrams.Grams(), ["a b a b", "", None, "c a b", "B, a!"]
    feats, doc = grams.of(texts)
    some = np.unique(feats)[::2]
    model = ngrams.Linear(some, np.arange(1.0, len(some) + 1), -3)
    for i, got in enumerate(model.scores(feats, doc, len(texts))):
        own = set(feats[doc == i].tolist())
        z = -3 + sum(w for f, w in zip(some.tolist(), range(1, len(some) + 1)) if f in own)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 30, 8).astype(np.uint64)) for _ in range(40)]
    y = np.array([int(3 in r) for r in rows])
    model = quality.fit_ftrl(rows, y, steps=200, least=1)
    z, n = {}, {}

    def weight(f, free):
        zi = z.get(f, 0.0)
        return 0.0 if abs(zi) <= free else -(zi - np.sign(zi) * free) / ((1 + np.sqrt(n.get(f, 0.0))) / 0.15 + 1)

    for t in range(200):
        fs = [*rows[t % 40].tolist(), "bias"]
        w = {f: weight(f, 0.0 if f == "bias" else 1.0) for f in fs}
        g = (1 / (1 + np.exp(-sum(w.values()))) - y[t % 40]) / np.sqrt(len(fs))
        for f in fs:
            old = n.get(f, 0.0)
            z[f] = z.get(f, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / 0.15 * w[f]
            n[f] = old + g * g
    want = {f: weight(f, 1.0) for f in z if f != "bias" and weight(f, 1.0)}
    assert dict(zip(model.features.tolist(), model.weights.tolist())) == pytest.approx(want)
    assert model.bias == pytest.approx(weight("bias", 0.0))


def test_nnpu_finds_the_positive_words_without_negatives():
    rng = np.random.default_rng(1)

    def doc(toxic):
        return np.unique(np.append(rng.integers(100, 300, 30), [7, 8][rng.integers(0, 2)] if toxic else 400)).astype(np.uint64)

    model = toxicity.fit_nnpu([doc(True) for _ in range(150)], [doc(i % 5 == 0) for i in range(600)], 0.2)
    test = [doc(i % 2 == 0) for i in range(200)]
    s = model.scores(np.concatenate(test), np.repeat(np.arange(200), [len(t) for t in test]), 200)
    assert np.mean((s >= 0.5) == (np.arange(200) % 2 == 0)) >= 0.98


def test_trigrams_and_bundles_against_plain_loops():
    texts = ["Straße, naïve  x", "", None, "ab 12 c", "漢字かな éÉ"]
    vectors = langid.Vectors(64)
    met = langid.packed(*(np.array([ord(w[k]) if w[k] != " " else 0 for w in (" st", "str", "ab ")]) for k in range(3)))
    got, share = langid.bundle(texts, vectors, np.sort(met))
    assert share.tolist() == pytest.approx([2 / 12, 0, 0, 1 / 3, 0]) and np.array_equal(langid.bundle(texts, vectors)[0], got)
    for text, row in zip(texts, got):
        want = np.zeros(64)
        letters = [c.lower()[0] if c.isalpha() else " " for c in text or ""]
        run = "".join([" ", *letters, " "])
        while "  " in run:
            run = run.replace("  ", " ")
        for a, b, c in zip(run, run[1:], run[2:]):
            if b != " ":
                x, y, z = (vectors.of(np.array([0 if s == " " else ord(s)]))[0].astype(int) for s in (a, b, c))
                want += np.roll(x, 2) * np.roll(y, 1) * z
        assert np.array_equal(row, want), text


def test_languages_and_awkward_rows(docs, none):
    got = langid.identify(docs, "_l")
    assert got.columns == [*docs.columns, "_l"]
    rows = got.collect()
    assert all(0 <= r["_l"]["score"] <= 1 for r in rows)
    assert all(r["_l"]["lang_pred"] == "und" for r in rows if not any(c.isalpha() for c in r["text"] or ""))
    plain = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 60 and r["text"] and not r["text"].startswith("another")]
    assert np.mean([r["lang"] == r["_l"]["lang_pred"] for r in plain]) >= 0.95
    assert langid.identify(none, "_l").collect() == []


def test_licences(spark, docs, none):
    data = [(i, t, "en", "s", 1, "x", 1, None, 0.5, 7) for i, t in enumerate([
        "Released under the MIT License.\nth er an on", "x\n\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", None, "", "\n\n",
        "He lost his license near the public library in version two of the story.", "Released MIT GNU apache the of under a License to be",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files, to deal in the program without restriction",
    ])]
    got = {r["doc_id"]: r["_c"] for r in license.scan_licences(spark.createDataFrame(data, tables.DOCS).unionByName(docs.filter("doc_id < 60").withColumn("doc_id", docs.doc_id + 100)), "_c").collect()}
    want = {0: ["MIT"], 1: ["Apache", "MIT"], 2: ["GPL"], 3: ["CC-BY-NC"], 9: ["MIT"]}
    assert {k: v["families"] for k, v in got.items() if v["families"]} == want
    assert got[1]["n_paragraphs"] == 2 and got[4]["score"] == 0
    assert license.scan_licences(none, "_c").collect() == []
