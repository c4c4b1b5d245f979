"""WARC archives: written by Spark tasks, one gzip member per record, and read back by byte ranges.

A reading task gets a range of a file. It looks for the gzip magic from the start of its range, takes a
candidate only if the bytes there decompress to a WARC header that is whole and names its length, and owns
the records whose first byte lies in its range; the last one may end beyond it. From an owned record on,
the next starts where that one ends. A header may be of any length. ``check_counts`` holds the records read
against those written.

Nulls and edge cases: null html is an empty payload; a null url leaves out the target header; a null page_id
leaves out the id and never is the smallest; rows with equal page_id and payload get the same type; an empty
table gives no records. Only page_id, url and html are read, so further columns of any name do no harm.
A member stored uncompressed that itself holds a whole WARC file would be mistaken for records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleepsignal.llm.common import open_fs, shared_folder, small_batches, write_file
from sleepsignal.session import cut

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
SALTS = 16
FILE_BYTES = 64_000_000
RANGE_BYTES = 8_000_000

RECORDS = (
    "file string, position long, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, which name the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    lines = [("WARC-Type", kind), ("WARC-Date", DATE)]
    if page_id is not None:
        lines.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    lines.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = http if kind == "revisit" else http + payload
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + END) + z.flush()


def parse_header(data: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name, if ``data`` starts with a whole WARC header; else None."""
    end = data.find(END)
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict(line.split(":", 1) for line in lines if ":" in line)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class Range:
    """Records of a file that start in [start, end)."""

    def __init__(self, uri: str, start: int, end: int, block: int = 1 << 20):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.start, self.end, self.block = start, min(end, self.size), block
        self.at, self.held = 0, b""

    def view(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(max(n, self.block), at)
        return self.held[at - self.at: at - self.at + n]

    def member(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Header, block and end of the record at ``at``; None if no record starts there."""
        z, out, place = zlib.decompressobj(31), bytearray(), at
        fields, seen = None, 0
        while not z.eof:
            data = self.view(place, min(16_384 if place == at else self.block // 2, self.size - place))
            if not data:
                return None
            try:
                out += z.decompress(data)
            except zlib.error:
                if fields is not None:
                    raise
                return None
            place += len(data)
            if fields is None:
                head = out.find(END, seen)
                seen = max(0, len(out) - len(END) + 1)
                fields = parse_header(bytes(out[: head + len(END)])) if head >= 0 else None
                if fields is None and (z.eof or head >= 0 or not b"WARC/1.".startswith(bytes(out[:7]))):
                    return None
        body = head + len(END)
        return fields, bytes(out[body: body + int(fields["content-length"])]), place - len(z.unused_data)

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        at = self.start
        while at < self.end:
            if self.view(at, min(3, self.size - at)) != MAGIC:
                data = self.view(at, min(self.block, self.end + 2 - at, self.size - at))
                found = data.find(MAGIC)
                if found < 0:
                    at += max(1, len(data) - 2)
                    continue
                at += found
                if at >= self.end:
                    return
            got = self.member(at)
            if got is None:
                at += 1
                continue
            fields, block, end = got
            yield at, fields, block
            at = end


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz`` in ``folder``; one row per file.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the smallest page_id is kept whole, the others
    refer to it. Only digests that occur twice are joined, over ``SALTS`` shares of each, so a page that makes
    up a third of the table is spread over as many tasks.
    """
    small_batches(pages.sparkSession)
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    twice = (
        rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    known = rows.withColumn("salt", salt).join(twice, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    known = known.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, n = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            write_file(folder, name, held)
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record("response" if first is None else "revisit", page_id, url, payload, first))
                size, n = size + len(held[-1]), n + 1
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, n, seq = [], 0, 0, seq + 1
        if held:
            yield flush()

    return cut(known.mapInArrow(write, "file string, bytes long, records long"))


def page_of(urn: str | None) -> int | None:
    return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn and urn.startswith("<urn:page:") else None


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """All response and revisit records of ``files`` (file, bytes), read in ranges of ``range_bytes``.

    The digest of each whole payload is computed again and must match its header; a revisit's length is the
    one in its HTTP headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for at, f, block in Range(r["file"], r["start"], r["start"] + range_bytes).records():
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(END)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    whole = f["warc-type"] == "response"
                    length = len(payload)
                    if whole and base32_sha1(payload) != digest:
                        raise ValueError(f"{r['file']} at {at}: payload does not match its digest")
                    if not whole:
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    rows.append((
                        r["file"], at, page_of(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"], length,
                        digest, page_of(f.get("warc-refers-to")), payload if with_payload and whole else None,
                    ))
                    held += (len(payload) if with_payload else 200) + len(rows[-1][3] or "")
                    if held > 8_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, min(100_000, ranges.count()))
    out = ranges.repartition(n, "file", "start").mapInArrow(read, RECORDS)
    return out if with_payload else out.drop("payload")


def check_counts(written: DataFrame, records: DataFrame) -> None:
    """Raise if a file of ``written`` (file, records) has not as many ``records`` as were written to it."""
    name = F.element_at(F.split("file", "/"), -1).alias("name")
    read = records.groupBy(name).agg(F.count(F.lit(1)).alias("n_read"))
    both = written.groupBy(name).agg(F.sum("records").alias("n")).join(read, "name", "full")
    wrong = both.filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("n_read", F.lit(0)))).orderBy("name").limit(5).collect()
    if wrong:
        raise ValueError("records read differ from those written: " + ", ".join(f"{r['name']} {r['n_read'] or 0} of {r['n'] or 0}" for r in wrong))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder with their sizes, by Spark's own file listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
