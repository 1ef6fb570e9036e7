"""Operator 4: WARC archives with an index that is written first and read by byte ranges.

Each input partition becomes one archive; every record has an index row (file, offset,
length, url, digest) kept as a Parquet table beside the archives. A reader takes any
selection of index rows, sorts it by place and joins neighbours into range reads.

Of records with equal payloads of at least ``least`` bytes, the one with the largest key is
``response`` and holds the payload; the others are ``revisit`` records that refer to it.
Smaller records are all ``response``.

Defined results: a null html is an empty payload; a null url leaves the target header out;
rows that share the largest key are all ``response``; a null key never is the largest, and
where no row of equal payload has a key all of them are ``response``. A payload of any length is
one record. An empty table gives an empty index. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, new_file, open_fs, ranges, scope, shared_dir

#: Payloads below this size are stored each time.
LEAST_BYTES = 1000
#: Most duplicate digests that are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Capture date of every record; a fixed one, so that a task that runs again writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, key long"
RECORD_SCHEMA = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def build_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """(key, type, refers to, payload bytes, digest, payload or None) of one record, digest verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/") or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:-4]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("record length is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Key"), kind, number("X-Refers-To-Key"), size, digest, payload if kind == "response" else None


def plan_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (key, url, payload) with digest and ``refers_to``.

    Only digests that occur twice or more are joined back. The counts combine on the map
    side, and the join deals hot digests anew when it shuffles.
    """
    sized = pages.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    twice = (
        sized.where(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.max("key").alias("largest"), F.count("*").alias("n"))
        .where("n > 1 and largest is not null")
        .drop("n")
    )
    twice = materialize(twice, "warc-duplicates")
    small = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(twice) if small else twice, ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest")


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write one archive a partition below ``path``; returns the index, itself a table at ``path``/index."""
    pages = df.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc"
        out, offset = None, 0
        try:
            for batch in batches:
                if out is None:
                    out = new_file(fs, f"{folder}/{name}")
                rows = []
                keys, urls, _, digests, refers = (batch.column(i) for i in range(5))
                for k, u, p, d, r in zip(keys.to_pylist(), urls.to_pylist(), batch.column(2), digests.to_pylist(), refers.to_pylist()):
                    record = build_record(k, u, p.as_py(), d, r)
                    out.write(record)
                    rows.append((name, offset, len(record), u, d, k))
                    offset += len(record)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        finally:
            if out is not None:
                out.close()

    bounded_batches(df.sparkSession)
    with scope(df.sparkSession, "warc-work"):  # the table of repeated digests goes when the archives are there
        planned = plan_revisits(pages, least).select("key", "url", "payload", "digest", "refers_to")
        planned.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return df.sparkSession.read.parquet(f"{path}/index")


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """The records that ``index`` (any selection of index rows) points at; see ``RECORD_SCHEMA``.

    ``payload`` of a revisit is null: its bytes are those of the record it refers to.
    """
    tasks = max(1, index.select("file").distinct().count())
    number = F.pmod(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), F.lit(tasks))  # a file a task where the index is whole
    rows = index.select("file", "offset", "length", "url").repartitionById(tasks, number).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        held, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            urls = batch.column(3).to_pylist()
            for file, begin, end, members in ranges(places):
                if held != file:
                    if source is not None:
                        source.close()
                    held, source = file, fs.open_input_file(f"{folder}/{file}")
                source.seek(begin)
                block = source.read(end - begin)
                out = []
                for i in members:
                    k, kind, refers, size, digest, payload = parse_record(block[places[i][1] - begin : places[i][1] - begin + places[i][2]])
                    out.append((k, urls[i], kind, refers, size, digest, payload))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])
        if source is not None:
            source.close()

    return rows.mapInArrow(read, RECORD_SCHEMA)


def archive(df: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """(folder, index) of the archives of ``df``."""
    path = path or shared_dir(df.sparkSession, "warc")
    return path, write_archives(df, path)
