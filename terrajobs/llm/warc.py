"""WARC archives whose records are Zstandard frames over a common dictionary.

A file begins with a skippable frame that holds the dictionary; each record follows as a frame of its own, so a reader
can start at any record. The dictionary is built once, from a bounded sample of the records to be archived, and every
file carries it: a file can be read by itself.

Files go to the shared folder, or any store that pyarrow can reach. A task writes under a name of its own attempt and
moves the file to its final name, so a repeated or speculative attempt leaves the same file; what counts is the manifest.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.storage import fresh_path, materialize

#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 1000
#: The dictionary's size, and the records that it is built from: so many, by hash of their id, and so many bytes of each.
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 4096
LEVEL = 3
#: Magic number of the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
#: Records carry the time of capture; these tables have none, and a rerun must write the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Holds, as JSON, an address that had to be encoded to be a URI.
ORIGINAL = "X-Original-Address"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    return int(uri[10:-1]) if uri and uri != _record_uri(None) else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone; its Content-Length is that of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # A line break in a url would end the header; such characters are percent-encoded in URIs, and a field of our own has the url as it was.
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        *([] if uri is None else [f"WARC-Target-URI: {uri}"]),
        *([] if uri == url else [f"{ORIGINAL}: {json.dumps(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on samples; empty where they are too few or too much alike to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _roles(pages: DataFrame) -> DataFrame:
    """``page, digest, size, refers_to, revisit`` of every row: who holds the payload and who points to it.

    Payloads are equal by SHA-256 and length. Groups shrink to a row each before the join back, in which AQE splits hot ones.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("key"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")
    )
    rows = materialize(rows, "payloads")
    holders = rows.where(F.col("size") >= LEAST_BYTES).groupBy("key", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(holders, ["key", "size"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "key", "digest", "size", F.when(revisit, F.col("holder")).alias("refers_to"), revisit.alias("revisit"))


def _dictionary(pages: DataFrame) -> bytes:
    """From the start of a bounded number of records, those of least hash: the same however the table is dealt.

    A threshold on the hash leaves some twice as many as are wanted before they are ordered, so tasks send rows in
    proportion to their share of the sample and not up to a whole sample each.
    """
    start = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES)
    spot = F.shiftrightunsigned(F.xxhash64("page_id", F.coalesce("url", F.lit(""))), 2)
    share = min(1.0, 2 * SAMPLE_RECORDS / max(1, pages.count()))
    some = pages.where(spot <= int(share * (1 << 62))).select(spot.alias("h"), F.coalesce(F.col("url"), F.lit("")).alias("url"), start.alias("html"))
    rows = some.orderBy("h", "url", "html").limit(SAMPLE_RECORDS).collect()
    return build_dictionary([record(0, r["url"], r["html"].encode(), len(r["html"]), hashlib.sha1(r["html"].encode()).hexdigest(), None, False) for r in rows])


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final = f"{root}/part-{context.partitionId():05d}.warc.zst"
        own = f"{root}/.{context.taskAttemptId()}-{uuid.uuid4().hex}"
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=True)
        records = size = 0
        with store.open_output_stream(own, compression=None) as out:
            out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for batch in batches:
                for row in zip(*(batch[n] for n in ("page_id", "url", "html", "size", "digest", "refers_to", "revisit")), strict=True):
                    page_id, url, html, n, digest, refers_to, revisit = (x.as_py() for x in row)
                    out.write(packer.compress(record(page_id, url, (html or "").encode(), n, digest, refers_to, revisit)))
                    records += 1
            size = out.tell()
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{final.rsplit('/', 1)[1]}"]), pa.array([records]), pa.array([size])], names=MANIFEST.names)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the manifest: ``path, records, bytes``.

    Null html is an empty payload and a null url has no target header. Of records with equal payloads of at least
    LEAST_BYTES bytes the one with the largest page_id is the response (rows that repeat that page_id and payload all
    are), the others revisit it; smaller ones are all responses. A null page_id never holds the payload for
    others. An empty table gives files without records.
    """
    dictionary = _dictionary(pages)
    roles = _roles(pages)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html.cast("binary"), 256).alias("key"))
    # Rows that repeat id and payload have the same role; one row of it each.
    roles = roles.distinct()
    # The join deals the pages out by id; a task writes what it is dealt, so payloads move once.
    planned = rows.join(roles, rows["page_id"].eqNullSafe(roles["page_id"]) & (rows["key"] == roles["key"])).select(rows["page_id"], "url", "html", "size", "digest", "refers_to", "revisit")
    return materialize(planned.mapInArrow(_writer(folder, dictionary), MANIFEST), "manifest")


def _frames(file) -> Iterator[bytes]:
    """Records of one archive, a frame at a time; the stream is read forward only."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("not a dictionary-compressed archive")
    dictionary = file.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    source = io.BufferedReader(reader.stream_reader(file, read_across_frames=True), 1 << 20)
    while line := source.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not begin with its version")
        head = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = source.read(int(head["content-length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def parse(head: dict, block: bytes) -> tuple:
    """A row of RECORDS. A response's digest and length are those of the payload read; they must be those declared."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['warc-record-id']} is not what its header says")
    url = json.loads(head[ORIGINAL.lower()]) if ORIGINAL.lower() in head else head.get("warc-target-uri")
    return _page_of(head["warc-record-id"]), url, size, digest, head["warc-type"], _page_of(head.get("warc-refers-to")) if revisit else None, None if revisit else payload


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as file:
                    rows, held = [], 0
                    for head, block in _frames(file):
                        row = parse(head, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block) if payloads else 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=RECORDS.names)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in ``manifest`` (path), one row each; ``payloads`` False leaves them out after checking them.

    A file is one task's, read as a stream: a record and some megabytes of rows are held.
    """
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(files, "path").mapInArrow(_reader(payloads), RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and tell what each record holds."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(manifest, payloads=False).drop("url", "payload")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM m
"""
