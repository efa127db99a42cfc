"""WARC archives, index first: each record's place is written down as it is stored,
and readers fetch only the selected records by coalesced byte ranges.

Writing: rows with equal payloads (SHA-256 and length) have the smallest page id
as response, others revisit it. Which rows revisit is found from digests alone, by a plain
equi-join with one row per digest, of which Spark can split a hot side;
those pairs are a written table, so the planner broadcasts it only if its size
allows that, and else joins by page id, which no hot payload can skew. Every
task streams its records into one file of the shared folder, a gzip member each,
and returns index rows (file, offset, length, url, digest, ...). Files of tasks
that ran twice are never named by the index.

Reading: index rows are range-sorted by file and offset; neighbours less than
MAX_GAP bytes apart are read as one range of at most MAX_RANGE bytes, then each
record is unpacked, parsed and held against its digest.

Defined results: a null html is an empty payload, a null url has no target URI;
payloads of fewer than ``min_bytes`` bytes never revisit; rows that repeat
both page id and payload tie as smallest, and all of them are alike (all
responses, or all revisits of the same page); a null page id is larger than any
other, and among null ids alone all are responses; an empty table gives no
records; other columns are not carried, so names cannot clash. A record is held
in memory whole, so a payload may be as long as a worker has memory for, twice.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, new_path, pick, write_table

MAX_GAP = 1 << 16
MAX_RANGE = 8 << 20
LEVEL = 4
#: Fixed values of the format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"
INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """A record and its payload's digest."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        target = quote(url, safe="!#$&'()*+,/:;=?@[]~%")
        head.append("WARC-Target-URI: " + target)
        if target != url:  # as it was, for readers of this module
            head.append("Page-URL: " + json.dumps(url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def pack(data: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, wbits=31)
    return made.compress(data) + made.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, the payload kept in the record, and the length of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    (size,) = re.findall(rb"\r\nContent-Length: (\d+)", http) or [b"0"]
    return fields, payload, int(size)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the index, a written table."""
    spark = pages.sparkSession
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("html", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("key", F.sha2("html", 256))
    slim = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "key")
    firsts = slim.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    again = slim.join(firsts, "key").where("not page_id <=> first").groupBy("page_id", "key").agg(F.min("first").alias("refers_to"))
    again = write_table(again.withColumnsRenamed({"page_id": "again_id", "key": "again_key"}), "revisits")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left").select("page_id", "url", "html", "refers_to")
    place = new_path(spark, "warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        disk, root = fs.FileSystem.from_uri(place)
        disk.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        with disk.open_output_stream(f"{root}/{name}", compression=None) as out:
            info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            at = out.write(pack(info.encode()))
            batch: pa.RecordBatch | None = first
            while batch is not None:
                found: list[tuple] = []
                for i in range(batch.num_rows):
                    page, url, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                    data, digest = record(page, url, html, refers, refers is not None, date)
                    out.write(member := pack(data))
                    found.append((name, at, len(member), url, digest, page, "response" if refers is None else "revisit", refers))
                    at += len(member)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), INDEX_ARROW, strict=True)], schema=INDEX_ARROW)
                batch = next(batches, None)

    index = write_table(joined.mapInArrow(store, INDEX), "warc-index")
    drop_table(again)
    return index.withColumn("file", F.concat(F.lit(place + "/"), "file"))


def ranges(rows: Iterator[tuple[str, int, int]], max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length, ...) rows, sorted, that are read at once."""
    run: list = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + max_gap or row[1] + row[2] - run[0][1] > max_range):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(selected: DataFrame, payloads: bool = True, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """The records of selected index rows. A revisit has no payload of its own, yet its size and digest are the full payload's. With payloads=False the column is null; payloads are still read and held against their digests."""
    order = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
        opened, source = None, None
        for run in ranges(rows, max_gap, max_range):
            if run[0][0] != opened:
                if source is not None:
                    source.close()
                disk, path = fs.FileSystem.from_uri(run[0][0])
                opened, source = run[0][0], disk.open_input_file(path)
            begin = run[0][1]
            block = memoryview(source.read_at(run[-1][1] + run[-1][2] - begin, begin))
            found = []
            for _, offset, length in run:
                fields, payload, size = parse(zlib.decompress(block[offset - begin : offset - begin + length], wbits=31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"the record at {offset} of {opened} does not match its digest")
                page, refers = fields.get("Page"), fields.get("Refers-To-Page")
                url = json.loads(fields["Page-URL"]) if "Page-URL" in fields else fields.get("WARC-Target-URI")
                found.append((int(page) if page is not None else None, url, payload if payloads and kind == "response" else None, size, digest, kind, int(refers) if refers is not None else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), RECORD_ARROW, strict=True)], schema=RECORD_ARROW)
        if source is not None:
            source.close()

    return order.mapInArrow(fetch, RECORD)
