"""Range-coded ids and packing: exact round trips, bounds, awkward rows."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sleepsignal.llm import packing, rans
from sleepsignal.llm.common import WordTokens

LIBRARY = Tokenizer.from_file(tables.TOKENIZER)
ODD = [
    "", " ", "\n", None, "a\x01b \x01 c", "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>", "É é É ΑΣ İ ÇA x y\x1cz\x0bq",
    "漢字 한국 it's IT'S don't 123 4!!  \n\n\t x", "word, word. word!! ?! (word) _a_ a_b ß ÿ ŷ µ ª", "x" * 3000, "ẹ́ Å",
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check_words(texts, limit):
    w = WordTokens(tables.TOKENIZER, limit)
    for _ in range(2):  # the second time from the table
        ids, lens = w.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [whole(t) for t in texts]


def test_words_give_the_ids_of_whole_texts():
    texts = ODD + [r[1] for r in tables.rows()]
    check_words(texts, 400_000)
    check_words(texts, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=4))
def test_any_text_gives_the_ids_of_the_library(texts):
    check_words(texts, 3)


@pytest.mark.parametrize("n", [0, 1, 127, 65_536, 65_537, 700_001])
def test_file_round_trip(n, tmp_path):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(max=49_000).astype(np.int32)
    lens = np.array([n], np.int64)
    (tmp_path / "x").write_bytes(b"".join(rans.shard_bytes(ids, np.array([5]), np.array([1], np.uint8), lens, 49_408, 1)))
    shard = rans.Shard(f"file://{tmp_path}/x")
    assert (shard.ids(0, n) == ids).all()
    for _ in range(10):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_damage_is_seen(tmp_path):
    ids = np.arange(70_000, dtype=np.int32) % 900
    data = bytearray(b"".join(rans.shard_bytes(ids, np.array([5]), np.array([1], np.uint8), np.array([len(ids)]), 1000, 1)))
    data[20_000] ^= 255
    (tmp_path / "x").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="checksum"):
        rans.Shard(f"file://{tmp_path}/x").ids(0, len(ids))


def test_frequencies_sum_and_keep_rare_symbols():
    f = rans.frequencies(np.array([0, 10**12, 1, 1, 5]), 20)
    assert f.sum() == 1 << 20 and f[0] == 0 and (f[1:] > 0).all()


@pytest.mark.parametrize("shard_ids", [700, rans.SHARD_IDS])
def test_corpus_round_trip(docs, shard_ids):
    got = rans.read_ids(rans.write_ids(docs, tables.TOKENIZER, 1, shard_ids=shard_ids), with_ids=True).orderBy("start").collect()
    data = sorted(((r[0], r[1]) for r in tables.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in got] == [k for k, _ in data]
    at = 0
    for r, (_, text) in zip(got, data):
        ids = [*whole(text), 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)


def test_no_rows(none, spark):
    assert rans.encode_corpus(spark, none, tables.TOKENIZER).collect() == []
    assert packing.pack(none, tables.TOKENIZER).collect() == []


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_keeps_every_id_and_fits(docs, size):
    got = packing.pack(docs, tables.TOKENIZER, size=size, end_id=0, groups=16, with_ids=True).collect()
    want = Counter()
    for r in tables.rows():
        ids = [*whole(r[1]), 0]
        for p, a in enumerate(range(0, len(ids), size)):
            want[r[0], p, a, crc(ids[a: a + size])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    assert all(crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in full.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in got)
    assert len(full) <= -(-total // size) * 1.1 + 2


def decreasing(lengths, size):
    """Best fit, longest first, one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(size - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300), st.integers(1, 40))
def test_plans_place_every_length_once(lengths, groups):
    size, small = 100, 12
    counts = np.bincount(lengths, minlength=size + 1)
    large = packing.plan_large(counts, size, small, groups)
    load = Counter()
    big = sorted((n for n in lengths if n > small), reverse=True)
    starts = np.array(large.starts)
    for place, n in enumerate(big):
        k = np.searchsorted(starts, place, side="right") - 1
        load[large.sequence[k] + place - starts[k]] += n
    assert all(v <= size for v in load.values())
    rooms = np.bincount([size - v for v in load.values()], minlength=size + 1) if load else np.zeros(size + 1, int)
    tiny = packing.plan_small(counts, rooms, size, small)
    spot = Counter()
    order = sorted(zip(tiny.length, tiny.first, tiny.room, tiny.at, tiny.each, strict=True))
    for n in range(1, small + 1):
        for rank in range(counts[n]):
            _, first, room, at, each = max(o for o in order if o[0] == n and o[1] <= rank)
            spot[room, at + (rank - first) // each] += n
    assert all(v <= (room if room >= 0 else size) for (room, _), v in spot.items())
    assert all(at < rooms[room] for room, at in spot if room >= 0)
    used = len(load) + len([k for k in spot if k[0] < 0])
    if groups >= len(lengths):  # nothing is rounded up
        assert used <= 1.35 * decreasing(lengths, size) + 2
