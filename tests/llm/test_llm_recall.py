"""Decontamination: every overlap by the stated rule has a seed, for periodic and for random replacements."""

import itertools
import random

import numpy as np
import tables

from sleepsignal.llm import decontaminate as d


def test_every_smallest_overlap_holds_a_seed():
    """All patterns of 12, 16, 20 and 24 words of which a quarter differ; other lengths up to 25 hold one of these."""
    for length in (12, 16, 20, 24):
        differ = np.array(list(itertools.combinations(range(length), length // 4)), np.int64)
        patterns = (1 << length) - 1 - (1 << differ).sum(axis=1)
        missed = np.ones(len(patterns), bool)
        for mask in d.MASKS:
            for shift in range(length - len(mask) + 1):
                m = int(mask, 2)
                missed &= (patterns >> shift) & m != m
        assert not missed.any(), (length, int(missed.sum()))


def test_random_replacements_lose_nothing():
    """Every overlap by the rule, of items of 12 to 59 words with 10 to 25 % replaced, holds a seed."""
    rng = np.random.default_rng(5)
    masks = [np.flatnonzero(np.array(list(m)) == "1") for m in d.MASKS]
    seen = 0
    for n in range(12, 60):
        for share in (0.1, 0.15, 0.2, 0.25):
            for _ in range(16):
                equal = np.ones(n, bool)
                equal[rng.choice(n, round(n * share), replace=False)] = False
                if accepted(equal, n):
                    seen += 1
                    assert any(equal[m + k].all() for m in masks for k in range(n - m[-1])), equal
    assert seen > 2500


def accepted(equal, n):
    """The rule itself, stretch by stretch."""
    for a in range(len(equal)):
        right = 0
        for b in range(a, len(equal)):
            right += bool(equal[b])
            if b - a + 1 >= min(13, n) and 4 * right >= 3 * (b - a + 1):
                return True
    return False


def test_longest_overlap_against_all_stretches():
    rng = np.random.default_rng(2)
    for n in range(30):
        for share in (0.0, 0.3, 0.6, 0.75, 0.9, 1.0):
            equal = rng.random(n) < share
            good = [(b - a, -a) for a in range(n + 1) for b in range(a, n + 1) if 4 * equal[a:b].sum() >= 3 * (b - a)]
            size, start = max(good)
            assert d.longest_overlap(equal) == (-start, size - start)


def spoilt(text, at):
    w = text.split()
    for k in at:
        w[k] = f"other{k}"
    return " ".join(w)


def brute(text, item):
    """Whether the comparison accepts any alignment of the item."""
    w, x = np.array(text.split()), np.array(item.split())
    for shift in range(-len(x) + 1, len(w)):
        lo, hi = max(0, shift), min(len(w), shift + len(x))
        equal = w[lo:hi] == x[lo - shift: hi - shift]
        if accepted(equal, len(x)):
            return True
    return False


def test_replaced_words_are_found_as_by_brute_force(spark):
    rng = random.Random(17)
    items = [" ".join(f"{w}{k}" for k, w in enumerate(tables.words(rng, "en", n))) for n in (12, 13, 16, 20, 30, 40, 59, 60)]
    cases = [spoilt(t, range(phase, len(t.split()), 4)) for t in items for phase in range(4)]
    for t in items:
        n = len(t.split())
        cases += [spoilt(t, rng.sample(range(n), round(n * share))) for share in (0.1, 0.15, 0.2, 0.25) for _ in range(6)]
    around = [" ".join(tables.words(rng, "de", 70)) for _ in range(2)]
    long_item = " ".join(f"{w}-{k}" for k, w in enumerate(tables.words(rng, "en", 400)))
    items += [" ".join(items[5].split()[:17]), long_item]
    cases += [spoilt(items[-2], at) for at in ((12, 13), (8, 9), (0, 16), (3, 7, 11, 15))]
    cases += [spoilt(long_item, set(range(400)) - set(keep)) for keep in (range(200, 213), range(300, 312), range(0, 400, 2))]
    cases += [spoilt(items[1], (4, 5)), spoilt(items[1], (7, 9)), spoilt(items[1], (0, 12))]
    cases = [f"{around[0]} {c} {around[1]}" for c in cases]
    want = {k for k, c in enumerate(cases) if any(brute(c, t) for t in items)}
    assert len(want) > 100
    docs = tables.docs(spark, [(k, c, "en", "s", 1, "x", 1, None, 0.5, 7) for k, c in enumerate(cases)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r["doc_id"] for r in d.contamination(docs, bench).collect() if r["contaminated"]} == want


def test_words_far_from_a_seed_count(spark):
    """An overlap of 400 words whose seeds stand at its start only is reported whole."""
    words = [f"w{k}" for k in range(400)]
    text = [w if k < 20 or k % 4 else f"other{k}" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    (r,) = d.contamination(docs, bench).collect()
    assert (r["overlap_words"], r["equal_words"]) == (400, sum(a == b for a, b in zip(text, words)))
