"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tables
from hypothesis import given, settings
from hypothesis import strategies as st

from sleepsignal.llm import spelling

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            low = run.translate(UPPER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{low}".encode())
            if h % 199 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1:]
            n[low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def variants(spark, n, large):
    return found(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), large=large))


def related(rng, letters, count, longest):
    """Words that are edits of each other, many of them sharing their start or end."""
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(count // 4)}
    while len(words) < count:
        w = rng.choice(sorted(words))
        k = rng.randint(0, len(w))
        words.add(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:] or "a", w[:k] + rng.choice(letters) + w[k + 1:]]))
    return {w: rng.choice([5, 6, 7, 30, 200, 1000, 1000]) for w in sorted(words)}


@pytest.mark.parametrize("large", [2, 16, 10_000])
@pytest.mark.parametrize("letters, count, longest", [("ab", 250, 9), ("abcdeéÿß", 400, 6), ("ab漢😀", 120, 4)])
def test_all_near_words(spark, letters, count, longest, large):
    n = related(random.Random(count), letters, count, longest)
    assert variants(spark, n, large) == plain_variants(n)


def test_very_long_words(spark):
    base = "xy" * 3000
    n = {base: 500, base[:-1]: 6, base[:100] + "q" + base[100:]: 100, base[1:] + "zz": 9, "q" + base[1:]: 20}
    assert variants(spark, n, 2) == plain_variants(n)


def test_one_hot_prefix(spark):
    rng = random.Random(3)
    n = {"commonstart" + "".join(rng.choices("abcd", k=6)): rng.randint(5, 900) for _ in range(600)}
    assert variants(spark, n, 32) == plain_variants(n)


def test_counts_over_awkward_rows(spark, docs):
    rows = [*tables.rows(), *[(i, "Straße straÎe STRAßE ×÷ÿzzzzz kitchen kitchens Kitchen kichen kitchen", "en", "s", 1, "x", 1, None, 0.5, 7) for i in range(300)]]
    n = plain_counts(rows)
    got = spelling.word_counts(tables.docs(spark, rows)).collect()
    assert {r["word"]: r["n"] for r in got} == n
    assert found(spelling.spelling_variants(spelling.word_counts(tables.docs(spark, rows)))) == plain_variants(n)


def test_empty(spark, none):
    out = spelling.spelling_variants(spelling.word_counts(none))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=30, unique=True))
def test_group_comparison(words):
    """One stack of groups by length, without Spark: all near pairs that the bounds admit."""
    groups, starts, bounds = [], [], []
    for size in sorted({len(w) for w in words}):
        starts.append(len(groups))
        bounds.append((size, 0, 0, size + 1))
        groups += [w for w in words if len(w) in (size, size + 1)]
    starts = np.array(starts)
    rows, near, _ = spelling.compare(groups, np.full(len(groups), 5), starts, np.diff(np.append(starts, len(groups))), np.array(bounds))
    total = Counter()
    for i, k in zip(rows.tolist(), near.tolist(), strict=True):
        total[groups[i]] += k
    assert total == Counter({w: k for w in words if (k := sum(one_edit(w, v) for v in words))})
