"""Line dedup by range-partitioned line hashes, answered as compressed per-document keep bitmaps.

Line hashes are dealt into ranges of (hash, document) and sorted within each by document and position. A
stream over a range sees every line's first document before the others, so it holds one line at a time. A hash
with a third of all lines spreads over many ranges; what a range cannot know, the first document of a hash
that began in an earlier range, comes from a table of two rows per range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.storage import materialize

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Shorter keys are left alone.
LEAST_CHARS = 10
#: Stands for a null doc_id: one document, ordered first.
NULL_ID = -(1 << 63)

KEYS = T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "doc", "text_key", "pos")])
#: kind 0: a line to drop; 1: a line of the range's first hash, still open; 2: a hash at a range's edge with its first document there.
FOUND = T.StructType([T.StructField("kind", T.IntegerType())] + list(KEYS.fields))
BATCH = 65536


def _line_keys(least_chars: int):
    """(doc, text_key, text) -> a row per line long enough, and per document one with null hashes and its line count as pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, keys, places = [], [], [], []
            counts = []
            for doc, text_key, text in zip(batch["doc"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
                lines = text.as_py().split("\n")
                counts.append(len(lines))
                for pos, line in enumerate(lines):
                    line = line.strip(BLANKS)
                    if len(line) >= least_chars:
                        # bytes.lower() changes A-Z alone
                        digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()))
                        docs.append(doc)
                        keys.append(text_key)
                        places.append(pos)
                if len(docs) >= BATCH:
                    yield _rows(digests, docs, keys, places)
                    digests, docs, keys, places = [], [], [], []
            yield _rows(digests, docs, keys, places)
            null = pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, batch["doc"], batch["text_key"], pa.array(counts, pa.int64())], names=KEYS.names)

    def _rows(digests: list, docs: list, keys: list, places: list) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64())], names=KEYS.names
        )

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted range: FOUND rows. Holds a batch and the current hash with its first document."""
    current = None  # (h1, h2), first document, whether it is the range's first hash

    def out(kind, cols, mask):
        got = [c[mask] for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), kind, dtype="i4")), *map(pa.array, got)], names=FOUND.names)

    def edge(key, owner):
        one = [np.array([v], dtype="i8") for v in (*key, owner, 0, 0)]
        return out(2, one, slice(None))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[n].to_numpy(zero_copy_only=False) for n in KEYS.names]
        h1, h2, doc = cols[:3]
        starts = np.empty(len(h1), dtype=bool)
        starts[0] = current is None or (h1[0], h2[0]) != current[0]
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(starts)  # 0: continues the hash of the batch before
        owners = np.concatenate([[NULL_ID if current is None else current[1]], doc[starts]])
        opening = 1 if current is None else 0  # the run that may be the range's first hash
        first = (run == opening) if current is None or current[2] else np.zeros(len(run), dtype=bool)
        if current is None:
            yield edge((h1[0], h2[0]), doc[0])
        if first.any():
            yield out(1, cols, first)
        drop = ~first & (doc != owners[run])
        if drop.any():
            yield out(0, cols, drop)
        current = ((h1[-1], h2[-1]), owners[run[-1]], bool(first[-1]))
    if current is not None:
        yield edge(*current[:2])


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    """One bit a line, set where it stays, packed and deflated; null where every line stays."""

    def one(n, gone):
        if gone is None or not len(gone):
            return None
        keep = np.ones(int(n), dtype=bool)
        keep[np.asarray(gone, dtype="i8")] = False
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pd.Series([one(*x) for x in zip(n_lines, dropped, strict=True)], dtype=object)


def apply_bitmap(text: str, bitmap: bytes | None) -> str:
    """The lines of ``text`` that the bitmap keeps, joined by newlines."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join(line for line, stays in zip(lines, keep, strict=True) if stays)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc, text_key, n_lines, n_dropped, keep_bitmap``: which lines of each document stay.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least
    ``least_chars`` code points found in two documents keeps its lines in the smallest doc_id alone, all of them;
    shorter keys stay. ``text_key`` is xxhash64 of the text: rows that repeat a doc_id are one document to
    the rule but have bitmaps of their own; rows equal in both share one. Null text is one empty line. The bitmap
    is null where nothing is dropped. No rows give no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(_keyed(docs, id_col, text_col).mapInArrow(_line_keys(least_chars), KEYS), "line-keys")
    lines = keys.where(F.col("h1").isNotNull())
    ranges = lines.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    found = materialize(ranges.mapInArrow(_first_occurrences, FOUND), "line-runs")
    # Two rows per range at most, so as many as there are partitions.
    owners = found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    open_lines = found.where("kind = 1").join(F.broadcast(owners), ["h1", "h2"]).where("doc <> owner")
    dropped = found.where("kind = 0").select("doc", "text_key", "pos").unionByName(open_lines.select("doc", "text_key", "pos"))
    per_doc = dropped.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("gone"))
    docs_seen = keys.where(F.col("h1").isNull()).groupBy("doc", "text_key").agg(F.max("pos").alias("n_lines"))
    return docs_seen.join(per_doc, ["doc", "text_key"], "left").select(
        "doc", "text_key", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep_bitmap")
    )


@F.pandas_udf(T.StringType())
def _kept_sha256(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    digest = lambda t, b: hashlib.sha256(apply_bitmap(t, b).encode("utf-8", "surrogatepass")).hexdigest()
    return pd.Series([digest(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, the lines dropped and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    maps = keep_bitmaps(docs)
    texts = _keyed(docs, "doc_id", "text")
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")
    return texts.join(maps, ["doc", "text_key"]).select(
        doc_id, "n_lines", "n_dropped", _kept_sha256("text", "keep_bitmap").alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), marked AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
