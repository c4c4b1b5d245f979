"""Bounded-space online packing: exact cover, no padding, bounded windows, awkward rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sleepsignal.llm import online_packing

LIBRARY = Tokenizer.from_file(tables.TOKENIZER)


def power_of_two(n):
    return n & (n - 1) == 0


def check_pieces(rows, ids_of, size):
    """Each id in one piece, sequences gapless and full but for powers of two; ``ids_of`` maps (doc_id, tokens) to ids."""
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0
        ids = ids_of[r["doc_id"], r["doc_tokens"]][r["start"]: r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.asarray(ids, "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == size or (at < size and power_of_two(at))
    return sequences, seen


def covered(spans, total, times=1):
    marks = np.zeros(total, int)
    for a, n in spans:
        marks[a: a + n] += 1
    return (marks == times).all()


@pytest.mark.parametrize("parts, size, windows", [(1, 4096, 16), (7, 64, 3), (4, 1, 2)])
def test_whole_corpus(spark, parts, size, windows):
    data = [r for r in tables.rows() if size > 1 or len(r[1] or "") < 400]
    got = online_packing.pack_online(tables.docs(spark, data).repartition(parts), tables.TOKENIZER, size, 2, windows).collect()
    ids_of, times = {}, defaultdict(int)
    for r in data:
        ids = [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 2]
        ids_of[r[0], len(ids)] = ids
        times[r[0], len(ids)] += 1
    _, seen = check_pieces(got, ids_of, size)
    assert set(seen) == set(ids_of)
    assert all(covered(spans, k[1], times[k]) for k, spans in seen.items())


def test_empty_table(spark, none):
    got = online_packing.pack_online(none, tables.TOKENIZER)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() == 0


def test_session_setting_is_restored(spark, none):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    online_packing.pack_online(none, tables.TOKENIZER)
    assert spark.conf.get(name) == before


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 16), st.integers(1, 4))
def test_windows_stay_bounded(lengths, size, most):
    packer, held = online_packing.Packer(size, most), defaultdict(int)
    for i, n in enumerate(lengths):
        for _, _, n_piece, _, number, offset, _ in packer.add((i,), bytes(4 * n)):
            assert offset == held[number]
            held[number] += n_piece
        assert len(packer.open) == len(packer.rooms) <= most
        assert all(0 < w.held < size for w in packer.open.values())
    assert all(n == size for n in held.values())
    left = sum(p[2] for _, pieces in packer.leftovers() for p in pieces)
    assert sum(held.values()) + left == sum(lengths)


def test_best_fit_then_fullest():
    packer = online_packing.Packer(10, 2)
    assert not list(packer.add(("a",), bytes(4 * 6))) and not list(packer.add(("b",), bytes(4 * 8)))
    assert not list(packer.add(("c",), bytes(4 * 3)))  # fits only beside a
    out = list(packer.add(("d",), bytes(4 * 5)))  # fits nowhere: a, the fullest, goes out with its first id
    assert [(p[0], p[1], p[2]) for p in out] == [("a", 0, 6), ("c", 0, 3), ("d", 0, 1)]
    assert sorted(w.held for w in packer.open.values()) == [4, 8]


@pytest.mark.parametrize("total, cuts", [(0, [0]), (8, [8]), (7, [0, 4, 6, 7]), (21, [16, 20, 21])])
def test_tail(total, cuts):
    assert online_packing.tail_cuts(total, 8) == cuts


def test_places_follow_tasks(spark):
    rows = [(p, k, (p * 7 + k) % 5 + 1) for p in (0, 3, 1023, 1024, 5000) for k in (2, 9)]
    got = {(r["part"], r["left"]): r["place"] for r in online_packing.places(spark.createDataFrame(rows, "part int, left int, fill long")).collect()}
    at = 0
    for p, k, fill in sorted(rows):
        assert got[p, k] == at
        at += fill
