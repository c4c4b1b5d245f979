"""The prefix trie against a plain trie of tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sleepsignal.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a long, names string, words int, _s int, block long, key string"


def plain_trie(rows, order):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(ts, key=lambda x: (x[0], x[1], order(x[2])))] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children, out = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    for node, cs in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    more = (1, 2, "x", 3, 4, 5, "y")
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA).repartition(parts)


def trie(spark, rows, **options):
    out = prefix_trie.prefix_trie(frame(spark, rows), **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def same(spark, rows, **options):
    assert trie(spark, rows, **options) == plain_trie(rows, lambda x: x)


def conversations(seed, count, longest, texts):
    """Many conversations that share starts of all lengths."""
    rng = random.Random(seed)
    made, rows = [], []
    for c in range(count):
        old = rng.choice(made) if made and rng.random() < 0.7 else []
        ts = old[: rng.randint(0, len(old))] + [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randint(0, longest))]
        ts = ts[: longest + 4] or [("user", "alone")]
        made.append(ts)
        rows += [(c, t, *x) for t, x in enumerate(ts)]
    rng.shuffle(rows)
    return rows


TEXTS = ["", None, "one", "two words", " a\tb\x0bc\nd\x1ce f ", "long " * 3000, "b"]


@pytest.mark.parametrize("height", [1, 2, 3, 16])
def test_shared_starts(spark, height):
    same(spark, conversations(height, 60, 9, TEXTS), height=height)


def test_deep_and_shallow(spark):
    rows = conversations(5, 45, 6, TEXTS)
    deep = [("user", f"turn {k % 7}") for k in range(2600)]
    for c, (keep, n) in {100: (0, 2600), 101: (1900, 2600), 107: (33, 70), 113: (17, 17), 119: (16, 16), 120: (700, 701)}.items():
        rows += [(c, k, *(deep[k] if k < keep or c == 100 else ("user", f"own {c}"))) for k in range(n)]
    rows += [(200 + c, k, "user", "again") for c in range(30) for k in range(90)]
    same(spark, rows)


def test_nulls_negative_numbers_and_missing_heads(spark):
    rows = [(None, 0, "user", "no number"), (-7, None, "user", "first"), (-7, -5, None, None), (-7, 3, "user", "last"), (-20, 0, "a", "base"), (-20, 1, "a", "base"),
            (7, 5, "user", "alone"), (27, 1000000000, "user", "x"), (27, -1000000000, "user", "y"), (27, 2048, "user", "z"), (20, 0, "s", "head")]
    same(spark, rows)


def test_equal_turns_and_repeated_rows(spark):
    rows = [(c, 0, "user", "same") for c in (0, 1, 2, 20, 21) for _ in range(5)] + [(3, 1, "user", "same")] * 3
    same(spark, rows)
    ties = [(0, 1, "user", t) for t in "abcdef"] + [(9, 1, "user", "a")]
    assert trie(spark, ties) == trie(spark, ties[::-1])
    assert sum(r[1] == 6 for r in trie(spark, ties)) == 1


def test_many_that_end_at_one_node(spark):
    rows = [(c * 37 - 300_000, 0, "user", "hello") for c in range(20_000)]
    same(spark, rows)


def test_empty(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
