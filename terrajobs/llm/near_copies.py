"""Near copies by SimHash and by the Jaccard similarity of word-shingle sets.

Candidates are texts whose SimHash fingerprints link (``simhash_segments``, over five-word shingles) and, since a similarity of
0.8 leaves fingerprints some 10 of 64 bits apart, where no grid tells texts apart, also texts of which all minhashes of some band
agree. Candidates form coarse groups, and within a group the shingle sets themselves are compared, so a text is linked by its exact
similarity alone. A pair at similarity s meets in a band with probability 1 - (1 - s^BAND_ROWS)^BANDS: 0.9999 at 0.8, more above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrajobs.functions.columns import rows_that
from terrajobs.functions.graph import connected_components
from terrajobs.functions.storage import materialize
from terrajobs.llm.simhash_segments import fingerprint_links, majority

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 24, 5
#: Texts of a coarse group that a task compares by itself; more are cut into blocks, one task per pair of blocks.
BLOCK = 1024
SEED = 42
#: Groups of several blocks up to which their table (16 bytes each) is broadcast.
MOST_BROADCAST = 100_000
#: Hashes whose votes are counted at a time.
CHUNK = 1 << 15

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype="u8")
_SALTS = _rng.integers(0, 1 << 63, BANDS, dtype="u8")

BANDED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField(n, T.LongType()) for n in ("group", "low", "high", "key")] + [T.StructField("shingles", T.ArrayType(T.LongType()))])
LINKS = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles, repeats included; a text of fewer words, or none, is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), dtype="<u8", count=n)


def band_keys(hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """One number a band: its minima mixed."""
    least = np.full(len(_FACTORS), np.iinfo("u8").max, dtype="u8")
    for i in range(0, len(hashes), chunk):
        least = np.minimum(least, (hashes[i : i + chunk, None] * _FACTORS + _TERMS).min(axis=0))
    keys = _SALTS.copy()
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, bands = np.zeros(batch.num_rows, dtype="u8"), []
        for i, text in enumerate(batch["text"]):
            hashes = shingle_hashes(text.as_py())
            fps[i] = majority(hashes[k : k + CHUNK] for k in range(0, len(hashes), CHUNK))
            bands.append(band_keys(np.unique(hashes)).view("i8"))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(fps.view("i8")), pa.array(bands, pa.list_(pa.int64()))], names=BANDED.names)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            sets = [np.unique(shingle_hashes(t.as_py())).view("i8") for t in some["text"]]
            yield pa.RecordBatch.from_arrays([*(some[n] for n in ("group", "low", "high", "key")), pa.array(sets, pa.list_(pa.int64()))], names=SETS.names)


def links_within(keys: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the all-pairs links of ``sets`` join.

    Members meet only what nothing has reached yet, so a dense group costs little more than its size.
    """
    of, out = similarity
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype("i4")
    sizes = np.array([len(s) for s in sets])
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marks = np.zeros(int(flat.max()) + 1, dtype=bool)
    left, a, b = np.arange(1, len(keys)), [], []
    flat, frontier = flat[sizes[0] :], [0]
    while len(left):
        if not frontier:
            frontier, left, flat = [left[0]], left[1:], flat[sizes[left[0]] :]
            continue
        at = frontier.pop()
        marks[own[at]] = True
        lengths = sizes[left]
        shared = np.add.reduceat(marks[flat], np.cumsum(lengths) - lengths, dtype="i8")
        marks[own[at]] = False
        near = shared * out >= (lengths + sizes[at] - shared) * of
        if near.any():
            hits = left[near]
            a.append(np.full(len(hits), keys[at], dtype="i8"))
            b.append(keys[hits])
            frontier.extend(hits.tolist())
            flat, left = flat[np.repeat(~near, lengths)], left[~near]
    none = np.zeros(0, dtype="i8")
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (group, low, high): the members of one group, or pair of its blocks, at a time."""
    at, keys, sets = None, [], []

    def flush() -> pa.RecordBatch:
        a, b = links_within(np.array(keys, dtype="i8"), sets)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)

    for batch in batches:
        places = zip(*(batch[n].to_pylist() for n in ("group", "low", "high")), strict=True)
        for place, key, row in zip(places, batch["key"].to_pylist(), batch["shingles"], strict=True):
            if place != at:
                if len(keys) > 1:
                    yield flush()
                at, keys, sets = place, [], []
            keys.append(key)
            sets.append(row.values.to_numpy(zero_copy_only=False))
    if len(keys) > 1:
        yield flush()


def text_key(text: str) -> Column:
    """Stands for the text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _copies(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``(marked, linked)``: doc_id and key of every row, and links of keys."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    marked = materialize(texts.mapInArrow(_band, BANDED), "bands")
    bands = marked.select("key", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    stars = bands.join(least.select("band", "least"), "band").where("key > least").select(F.col("key").alias("src"), F.col("least").alias("dst")).distinct()
    # Equal fingerprints meet at their least key, linked ones at the least keys of both.
    fps = materialize(marked.groupBy("fp").agg(F.min("key").alias("root"), F.max("key").alias("most")), "fingerprints")
    roots = fps.select("fp", "root")
    equal = marked.join(fps.where("root < most").select("fp", "root"), "fp").where("key > root").select(F.col("key").alias("src"), F.col("root").alias("dst"))
    linked = fingerprint_links(roots.select("fp"))
    ends = roots.withColumnsRenamed({"fp": "src", "root": "_src"}), roots.withColumnsRenamed({"fp": "dst", "root": "_dst"})
    near = linked.join(ends[0], "src").join(ends[1], "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    stars = stars.unionByName(equal).unionByName(near)
    groups = materialize(connected_components(stars).select(F.col("node").alias("key"), F.col("component").alias("group")), "groups")
    large = groups.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("n")).where("n > 1")
    large = materialize(large, "large-groups")
    # Groups of several blocks are few: broadcast while they are, so that no group is dealt to one task before it is cut.
    counted = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    mine = groups.join(counted, "group", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("n")))
    paired = mine.select("key", "group", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")).select(
        "key", "group", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    )
    # Of texts that several rows hold one is read.
    one = texts.select("key", "text").join(groups.select("key"), "key").groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    sets = one.join(paired, "key").select("group", "low", "high", "key", "text").mapInArrow(_shingled, SETS)
    linked = sets.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high").mapInArrow(_verify, LINKS)
    return marked.select("doc_id", "key"), materialize(linked, "links")


def keep_representatives(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, less those that links of similarity 0.8 or more join to a row before them.

    Of each group the row of smallest (doc_id, key) stays, null ids last. Equal texts are links; null and empty texts, and those
    of white space alone, are one text to the shingles. Rows that repeat the staying row's id and text come through each.
    """
    marked, links = _copies(docs, block)
    joined = connected_components(links)
    rows = marked.distinct().join(joined, F.col("key") == F.col("node"), "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    rows = materialize(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("of"))), "placed")
    first = rows.groupBy("component").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    gone = rows.join(first, "component").where("place > first").select("doc_id", "key")
    return rows_that(docs, [docs["doc_id"].cast("long"), text_key("text")], gone, ["doc_id", "key"], meet=False)
