"""WARC archives with an index that is written first.

Writing: every task writes gzip members, one a record, to archive files of its own in a shared folder, and gives an index row for
each record: file, offset, length, URL and digest. The index is a table that Spark commits, so files of a task that was run
again are in no index and are never read. Of records with equal payloads only one is stored, the others revisit it.

Reading: index rows are selected like any table, dealt by stretches of the archive files, sorted by offset, and neighbouring
byte ranges are read with one request.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.shared import arrow_schema, batched, bounded_batches, rows_of
from lakeloom.session import fresh_dir
from lakeloom.sources.lake import committed

INDEX = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "digest": pa.string(),
         "page_id": pa.int64(), "record_type": pa.string()}
RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
          "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
INDEX_DDL = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD_DDL = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint, payload binary")
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder as Spark names it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri[:1] == "/" else
                                    uri.replace("file:", "file://", 1))


def record_id(page_id: int | None) -> str:
    """The same id for the same page in any run, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, first, first_url, date: str) -> bytes:
    """One WARC record, not compressed. `first` is the page it revisits; None for a response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {RESPONSE if first is None else REVISIT}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {one_line(first_url)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(url: str) -> str:
    """A header's value: line ends and percent signs before them can't break the record."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("the record's length is not what its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6,
          file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) to archives in `folder`; the committed index.

    A null html is an empty payload. Of rows with equal payloads of at least `min_revisit_bytes` bytes those with the smallest
    page_id are responses and the others revisit it; smaller payloads are all responses. Rows without an id come last
    of all. Rows that repeat get a record each. Payloads are compared by SHA-1 and size. Columns other than the three
    are not read.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("bigint"))
    shared = named.filter(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"))
    # Only what really repeats is joined back. The join splits a digest with very many rows.
    firsts = shared.filter("n > 1").select("digest", "size", F.col("first.page_id").alias("first"),
                                           F.col("first.url").alias("first_url"))
    marked = named.join(firsts, ["digest", "size"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("first"),
                           F.when(revisits, F.col("first_url")).alias("first_url"))
    schema = arrow_schema(INDEX)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(records(batches), schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            for page_id, url, payload, digest, first, first_url in rows_of(
                    batch, "page_id", "url", "payload", "digest", "first", "first_url"):
                if out is None:
                    # A new name for every attempt: a task that runs again never touches a file of its first run.
                    name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                digest = base32(bytes.fromhex(digest))
                member = gzip.compress(record(page_id, url, payload, digest, first, first_url, date), level, mtime=0)
                out.write(member)
                yield (name, offset, len(member), url, digest, page_id, RESPONSE if first is None else REVISIT)
                offset += len(member)
                if offset >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    bounded_batches(spark)
    return committed(marked.mapInArrow(write_part, INDEX_DDL), "warc-index")


def read(index: DataFrame, folder: str, stretch: int = 64 << 20, gap: int = 64 << 10, most: int = 8 << 20,
         task_bytes: int = 8 << 20) -> DataFrame:
    """The records of the selected index rows.

    Rows are dealt by stretches of `stretch` bytes of each file, to a task for each `task_bytes` of records: index rows are small, so
    their own size would put all into one task. Within one, sorted ranges with at most `gap` bytes between are
    read together, up to `most` bytes at once. Payloads are checked against their digests; a damaged record fails.
    """
    schema = arrow_schema(RECORD)

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(records(batches), schema, 200)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, path = filesystem(folder)
        file, opened = None, None
        for name, ranges in coalesced((r for b in batches for r in rows_of(b, "file", "offset", "length")), gap, most):
            if name != file:
                if opened is not None:
                    opened.close()
                file, opened = name, store.open_input_file(f"{path}/{name}")
            start = ranges[0][0]
            held = opened.read_at(max(o + n for o, n in ranges) - start, start)
            for offset, length in ranges:
                yield decoded(held[offset - start:offset - start + length])
        if opened is not None:
            opened.close()

    bounded_batches(index.sparkSession)
    dealt = index.select("file", "offset", "length", F.floor(F.col("offset") / stretch).alias("stretch"))
    size = index.agg(F.sum("length")).first()[0] or 0
    dealt = dealt.repartition(max(1, -(-size // task_bytes)), "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(read_part, RECORD_DDL)


def coalesced(rows: Iterator[tuple], gap: int, most: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) rows as (file, ranges read together)."""
    name, held = None, []
    for file, offset, length in rows:
        if held and (file != name or offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield name, held
            held = []
        name = file
        held.append((offset, length))
    if held:
        yield name, held


def decoded(member: bytes) -> tuple:
    headers, http, payload = parsed(zlib.decompress(member, 31))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.decode().split("Content-Length: ")[1])
    page, first = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    if headers["WARC-Type"] == RESPONSE and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
        raise ValueError(f"the payload of page {page} is not what its record says")
    return (None if page is None else int(page), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
            None if first is None else int(first), payload)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive all pages in a new folder of the shared one, and read all records back."""
    folder = fresh_dir(spark, "warc")
    return read(write(pages, folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: ('0x' || hex[i:i+9])::UBIGINT) AS words FROM f)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(words, lambda w: array_to_string(list_transform(range(0, 8), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> (35 - 5 * j)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM b
"""
