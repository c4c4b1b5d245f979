"""Records whose headers are long, and records that are missing."""

import random
import zlib

import pytest

from sleepsignal.llm import queries, warc
from sleepsignal.llm.common import shared_folder

CJK = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))


def long_url(n, seed=1):
    return "data:" + "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))


ROWS = [(1, long_url(500_000), "one"), (2, "http://a", "two"), (3, f"http://b/{CJK}", "one"), (4, "u" * 2_000_000, None), (5, long_url(65_400, 2), "x" * 70_000), (6, None, "")]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)


@pytest.mark.parametrize("size", [5_000, 8_000_000])
def test_pages_with_long_urls_come_back(spark, size):
    files = warc.write_warc(pages(spark))
    records = warc.read_warc(spark, files, size).persist()
    warc.check_counts(files, records)
    got = {r["page_id"]: r for r in records.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert all(got[i]["url"] == u for i, u, _ in ROWS if i != 3)
    assert [got[i]["payload_bytes"] for i in (1, 2, 3, 4, 5, 6)] == [3, 3, 3, 0, 70_000, 0]


def test_the_query_returns_all_pages(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"] for r in queries.op2_warc_archive(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6}


def test_a_missing_record_is_an_error(spark):
    folder = shared_folder(spark, "warc")
    files = warc.write_warc(pages(spark), folder)
    records = warc.read_warc(spark, warc.list_warc(spark, folder))
    warc.check_counts(files, records)
    with pytest.raises(ValueError, match="0 of"):
        warc.check_counts(files, records.filter("page_id <> 2").filter("false"))
    with pytest.raises(ValueError, match="records read differ"):
        warc.check_counts(files, records.filter("page_id <> 2"))


def test_a_header_without_an_end_is_no_record(tmp_path):
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    broken = z.compress(b"WARC/1.1\r\n" + b"a" * 300_000) + z.flush()
    (tmp_path / "x").write_bytes(broken + warc.record("response", 1, "http://a", b"body", None))
    found = list(warc.Range(f"file://{tmp_path}/x", 0, 10**7).records())
    assert [f["warc-record-id"] for _, f, _ in found] == ["<urn:page:1>"]
