"""WARC archives, index first: an index of offset, length, URL and digest for each record, then coalesced range reads.

write_archives() has each task write archive files of its own (one gzip member per record) to a folder that all see, and
returns the index as a table. Equal payloads are written once: the record with the smallest page_id is the response, the others
are revisits that refer to it. read_records() takes selected rows of an index, sorts them by file and offset, joins
neighbours into ranges (gaps up to GAP, ranges up to RANGE bytes) and reads each range once.

Edge cases. A null html is an empty payload; empty payloads are equal to each other (MIN_REVISIT = 0 makes the others
revisits). A null url gives a record without a target URI. Repeated rows of the response's page_id and payload are all
responses. A null page_id is written and read back; it is the response only if its payload has no other id. An empty table gives
no file and an empty index. Further columns are not read. If a task is run again, it writes a new file; what the index doesn't
name is never read. Folders are reached by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import looked_up, new_path, read, stored, tune

MIN_REVISIT, FILE_BYTES, GAP, RANGE = 0, 64 << 20, 16 << 10, 4 << 20
#: Repeated digests up to this number are broadcast (some 100 bytes each), once they have been counted; bytes that a task reads.
FEW, READ = 100_000, 32 << 20
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def head(lines: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n").encode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record, compressed as a gzip member. A revisit has the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    urn = lambda k: "<urn:page:none>" if k is None else f"<urn:page:{k}>"
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", urn(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head(lines) + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple:
    """RECORD's values of a decompressed record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: None if v == "<urn:page:none>" else int(v[len("<urn:page:") : -1])
    said, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if kind == "revisit":
        return page(field["WARC-Record-ID"]), size, said, kind, page(field["WARC-Refers-To"]), True
    found = base32(hashlib.sha1(payload).digest())
    return page(field["WARC-Record-ID"]), len(payload), found, kind, None, found == said and size == len(payload)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, few: int = FEW) -> DataFrame:
    """Archives of pages (page_id, url, html) in `folder`; the index, stored there as well."""
    spark = pages.sparkSession
    tune(spark)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("sha1", F.sha1("html"))
    # Payloads that more than one row has: digests and ids alone, aggregated before they are dealt out.
    again = base.where(F.octet_length("html") >= min_revisit).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stored(again, "warc-repeats")
    if again.limit(few + 1).count() <= few:
        role = base.join(F.broadcast(again.drop("n")), "sha1", "left")  # the payloads stay where they lie
    else:
        role = looked_up(base, again, ["sha1"], base.count(), "left")  # those of hot digests do
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, at, name, rows = None, 0, "", []
        try:
            for batch in batches:
                for page, url, html, sha1, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    digest = base32(bytes.fromhex(sha1))
                    raw = record(page, url, html.encode(), digest, first, again)
                    out.write(raw)
                    rows.append((page, url, digest, "revisit" if again else "response", name, at, len(raw)))
                    at += len(raw)
                if len(rows) >= 1024:
                    yield _batch(rows, INDEX)
                    rows = []
            yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return stored(role.select("page_id", "url", "html", "sha1", "first", revisit.alias("again")).mapInArrow(run, INDEX), "warc-index")


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """(file, start, end, records array<struct<offset, length>>): selected records of a file near each other, in one read.

    A file holds FILE_BYTES at most and the window goes by file and stretches of `most` bytes, so no group grows with the input.
    """
    w = Window.partitionBy("file", "stretch").orderBy("offset")
    rows = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / most))
    far = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > gap, F.lit(True))
    rows = rows.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "stretch", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "start", "end", "records")


def read_records(index: DataFrame, folder: str, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The selected records, decompressed, parsed and held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                path, start, end, wanted = (batch.column(c)[k].as_py() for c in range(4))
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, store.open_input_file(f"{top}/{path}")
                raw = memoryview(file.read_at(end - start, start))
                yield _batch([parse(zlib.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]], 31)) for r in wanted], RECORD)
        if file is not None:
            file.close()

    # As many tasks as there are READ bytes to read: the ranges themselves are few bytes, which say nothing of the work.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ))
    return ranges(index, gap, most).repartition(tasks, "file", "start").sortWithinPartitions("file", "start").mapInArrow(run, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(read(spark, sf_dir, "pages"), folder)
    return read_records(index, folder)


#: Digests are RFC 4648 base32 of SHA-1: five bits a letter, eight letters from ten hexadecimal digits.
ORACLE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
q as (select *, min(page_id) over (partition by h) as first, count(*) over (partition by h) as n from p)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 8)::int * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when n = 1 or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when n = 1 or page_id is not distinct from first then null else first end as refers_to,
  true as intact
from q
"""
