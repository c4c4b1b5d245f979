"""WARC: whole round trips under any range size, revisits, awkward rows."""

import gzip

import pytest

from sleepsignal.llm import warc
from sleepsignal.llm.common import shared_folder

PAGES = "page_id long, url string, html string, digest string, salt int, first long"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://ü/4 x\ny", None), (5, "http://a/5", ""),
    (6, "http://a/6", "ü" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"), (None, "http://a/8", "<p>two</p>"),
    (9, "http://a/9", "".join(chr(33 + i * 7919 % 90) for i in range(70_000))), (1, "http://a/1", "<p>one</p>"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", 3, 1) for r in rows], PAGES).repartition(3)


def expected(least=0):
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        revisit = i != first[h or ""] and len(data) >= least
        out.append((i, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,least", [(97, 0), (8_000_000, 0), (1000, 20)])
def test_round_trip(spark, size, least):
    files = warc.write_warc(pages(spark), min_revisit_bytes=least)
    got = warc.read_warc(spark, files, size, with_payload=True).collect()
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(found, key=str) == expected(least)
    texts = {(h or "").encode() for _, _, h in ROWS}
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == texts


def test_listing_and_plain_gzip(spark):
    folder = shared_folder(spark, "warc")
    warc.write_warc(pages(spark), folder)
    listed = warc.list_warc(spark, folder)
    assert warc.read_warc(spark, listed).count() == len(ROWS)
    for r in listed.collect():
        with gzip.open(r["file"].removeprefix("file:")) as f:
            data = f.read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_no_rows(spark):
    assert warc.read_warc(spark, warc.write_warc(pages(spark, []))).collect() == []


def test_false_magic_is_passed_over(tmp_path):
    member = warc.record("response", 1, "http://a", b"body", None)
    (tmp_path / "x").write_bytes(b"\x1f\x8b\x08junk" + gzip.compress(b"no header") + member + b"\x1f\x8b" + member)
    found = list(warc.Range(f"file://{tmp_path}/x", 0, 10**6).records())
    assert [f["warc-record-id"] for _, f, _ in found] == ["<urn:page:1>"] * 2
