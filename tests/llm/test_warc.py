import hashlib
import os
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from terrajobs.functions.storage import fresh_path
from terrajobs.llm import warc as op

from .common import SMALL

BIG = "<html>" + "équal payload " * 200 + "</html>"
PAGES = [
    (1, "http://a.example/", BIG, "x"), (2, "http://b.example/%41 b\r\nWARC-Type: fake", BIG, "x"), (3, None, "short", "x"), (4, "http://c.example/", "short", "x"),
    (5, "http://d.example/", None, "x"), (6, "http://e.example/é", "", "x"), (7, "http://f.example/", "x" * 999, "x"), (8, "http://f.example/", "x" * 999, "x"),
    (9, "http://g.example/", "y" * 1000, "x"), (10, "http://g.example/", "y" * 1000, "x"), (10, "http://g.example/", "y" * 1000, "x"), (None, "http://h.example/", "y" * 1000, "x"),
    (None, "http://h.example/", "z" * 3000, "x"), (11, "http://i.example/", "WARC/1.1\r\n\r\n" * 500, "x"), (12, "http://i.example/", "p" * 3_000_000, "x"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    groups = defaultdict(list)
    for page, _, html, *_ in rows:
        groups[html or ""].append(page)
    out = Counter()
    for page, url, html, *_ in rows:
        data = (html or "").encode()
        keep = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = len(data) >= 1000 and keep is not None and page != keep
        out[(page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None, None if revisit else data)] += 1
    return out


def answers(df):
    return Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect())


def test_round_trip(spark):
    folder = fresh_path(spark, "warc-test")
    manifest = op.write_archives(spark.createDataFrame(PAGES, SCHEMA), folder)
    assert answers(op.read_archives(manifest)) == brute(PAGES)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_files_stand_alone(spark, tmp_path):
    """A dictionary frame first, then a frame per record that decompresses by itself with it."""
    manifest = op.write_archives(spark.read.parquet(f"{SMALL}/pages.parquet"), f"file://{tmp_path}/warc").collect()
    assert sorted(os.listdir(tmp_path / "warc")) == sorted(m["path"].rsplit("/", 1)[1] for m in manifest)
    for m in manifest:
        data = open(m["path"].removeprefix("file://"), "rb").read()
        assert len(data) == m["bytes"] and data[:4] == bytes.fromhex("5d2a4d18")
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
        rest, n = data[8 + size :], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            record = one.decompress(rest)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            rest, n = one.unused_data, n + 1
        assert n == m["records"]


def test_addresses_are_archived_as_they_are():
    """Escapes of an address stay; only what no URI may hold is encoded, and read back."""
    for url, uri in (("https://e.it/a%20b?c=%41", "https://e.it/a%20b?c=%41"), ("https://e.it/a b%20c\r\n", "https://e.it/a%20b%20c%0D%0A"), ("https://e.it/é\x85", "https://e.it/é\x85")):
        data = op.record(1, url, b"x", 1, hashlib.sha1(b"x").hexdigest(), None, False)
        head, _, block = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")[1:]
        assert f"WARC-Target-URI: {uri}" in lines
        assert op.parse({k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, block.removesuffix(b"\r\n\r\n"))[1] == url


def test_empty_table(spark):
    assert op.read_archives(op.write_archives(spark.createDataFrame([], SCHEMA), fresh_path(spark, "warc-test"))).count() == 0


def test_damage_is_seen(spark):
    head = {"warc-type": "response", "warc-record-id": "<urn:page:1>", "warc-payload-digest": "sha1:" + "0" * 40}
    with pytest.raises(ValueError):
        op.parse(head, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")


def test_dictionary_is_the_same_however_dealt(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert op._dictionary(pages) == op._dictionary(pages.repartition(7))
