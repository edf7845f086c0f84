"""SimHash near-dedup by segment popcounts.

A fingerprint's bits are cut into segments and each segment is mapped to its number of set bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a range join of the vectors
finds every link, and the fingerprints then verify it.

The range join runs over a grid. A link of ``radius`` bits leaves, in one of ``radius // 3 + 1`` parts of the vector, a
distance of two at most; so two linked vectors have, in that part, a grid point within one step of both. Each vector is
filed under its own grid point and those one step away, per part, and meets its partners at the shared ones.

Counts are written as thermometers (count c in a segment of w bits: the c lowest bits set). Then the Manhattan distance
is the Hamming distance of thermometers, a step is one flipped bit, and everything is 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.graph import connected_components
from terrajobs.functions.storage import materialize

SHINGLE = 4
RADIUS = 4
#: Bits in a segment: 1, 2, 4 or 8. Narrow segments tell more fingerprints apart and have more grid points nearby.
SEGMENT_BITS = 2
SEED = 42
#: Fingerprints at one grid point that a task compares by itself; more are cut into blocks, one task per pair of blocks.
BLOCK = 4096
#: Grid points with this many fingerprints or fewer are compared row by row, others by growing components.
FEW = 8

FINGERPRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
CELLS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("fp", T.LongType())])
#: hot 0: fingerprints a and b link; 1: grid point a holds too many, b is one of them.
MET = T.StructType([T.StructField("hot", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: str | None, shingle: int = SHINGLE, chunk: int = 1 << 15) -> int:
    """64-bit SimHash of the word shingles, repeats included; bit i is set where over half of the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype="i8", count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + chunk], stops[i : i + chunk], strict=True)], dtype="<u8") for i in range(0, n, chunk))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes, some at a time, have."""
    votes, n = np.zeros(64, dtype="i8"), 0
    for some in hashes:
        votes += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        n += len(some)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), dtype="u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got.view("i8"))], names=["doc_id", "fp"])

    return run


def thermometers(fps: np.ndarray, segment_bits: int) -> np.ndarray:
    """Segment counts of each fingerprint as thermometers: the embedding."""
    per_byte = 8 // segment_bits
    table = np.zeros(256, dtype="u1")
    for byte in range(256):
        for k in range(per_byte):
            count = bin(byte >> (k * segment_bits) & ((1 << segment_bits) - 1)).count("1")
            table[byte] |= ((1 << count) - 1) << (k * segment_bits)
    return table[np.ascontiguousarray(fps, dtype="<u8").view("u1")].view("<u8")


def _part_masks(radius: int) -> list[int]:
    """Bits of each part: whole bytes, as even as can be."""
    parts = min(8, radius // 3 + 1)
    cuts = [8 * k // parts * 8 for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def grid_cells(fps: np.ndarray, radius: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row): each fingerprint's own grid point and those one step away, for every part.

    A cell is the part's thermometer with the part's number mixed in.
    """
    if radius // min(8, radius // 3 + 1) > 2:
        raise ValueError("radius is too large for parts of a byte")
    codes = thermometers(fps, segment_bits)
    cells, rows = [], []
    everything = np.arange(len(fps))
    for k, mask in enumerate(_part_masks(radius)):
        own, salt = codes & np.uint64(mask), np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        cells.append(own ^ salt)
        rows.append(everything)
        for bit in range(64):
            if not mask >> bit & 1:
                continue
            base = bit - bit % segment_bits
            below = ((1 << bit) - (1 << base)) & mask
            above = ((1 << base + segment_bits) - (1 << bit + 1)) & mask
            legal = ((codes & np.uint64(below)) == np.uint64(below)) & ((codes & np.uint64(above)) == 0)
            cells.append((own[legal] ^ np.uint64(1 << bit)) ^ salt)
            rows.append(everything[legal])
    return np.concatenate(cells), np.concatenate(rows)


def _to_cells(radius: int, segment_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view("u8")
            for i in range(0, len(fps), 4096):
                some = fps[i : i + 4096]
                cells, rows = grid_cells(some, radius, segment_bits)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view("i8")), pa.array(some[rows].view("i8"))], names=CELLS.names)

    return run


def grow_components(fps: np.ndarray, radius: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what the all-pairs links of ``fps`` join: from the root of each component to its members.

    Members meet only what no component holds yet, so a dense group costs little more than its size.
    """
    left, codes = fps, thermometers(fps, segment_bits)
    roots, members = [], []
    while len(left) > 1:
        root, frontier = left[0], [(left[0], codes[0])]
        left, codes = left[1:], codes[1:]
        while frontier and len(left):
            fp, code = frontier.pop()
            near = np.bitwise_count(codes ^ code) <= radius  # Manhattan distance of the counts
            if near.any():
                near[near] = np.bitwise_count(left[near] ^ fp) <= radius
                hits = left[near]
                roots.append(np.full(len(hits), root, dtype="u8"))
                members.append(hits)
                frontier.extend(zip(hits, codes[near], strict=True))
                left, codes = left[~near], codes[~near]
    none = np.zeros(0, dtype="u8")
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def _few_links(cells: np.ndarray, fps: np.ndarray, radius: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links among rows that share a cell, for runs of few rows: each row against the next, the next but one, ..."""
    codes = thermometers(fps, segment_bits)
    a, b = [np.zeros(0, dtype="u8")], [np.zeros(0, dtype="u8")]
    for lag in range(1, FEW):
        at = np.flatnonzero(cells[lag:] == cells[:-lag])
        if not len(at):
            break
        at = at[np.bitwise_count(codes[at] ^ codes[at + lag]) <= radius]
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        a.append(fps[at])
        b.append(fps[at + lag])
    return np.concatenate(a), np.concatenate(b)


def _met(hot: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot, dtype="i4")), pa.array(a.view("i8")), pa.array(b.view("i8"))], names=MET.names)


def _unique_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points nearby show the same link again; one batch keeps it once."""
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype="u8")
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _meet(radius: int, segment_bits: int, block: int):
    """Stream rows sorted by (cell, fp); holds one batch and the run of the current cell, up to ``block`` rows of it."""

    def compare(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.append(starts, len(cells)))
        few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        got = [_few_links(cells[few], fps[few], radius, segment_bits)] if few.any() else []
        got += [grow_components(fps[s : s + n], radius, segment_bits) for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True)]
        if got:
            a, b = _unique_links(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            if len(a):
                yield _met(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype="u8"), np.zeros(0, dtype="u8"))
        spilling = None  # the cell whose rows go on as hot ones
        for batch in batches:
            cells, fps = (np.concatenate([h, batch[n].to_numpy(zero_copy_only=False).view("u8")]) for h, n in zip(held, ("cell", "fp"), strict=True))
            if spilling is not None:
                on = np.searchsorted(cells != spilling, True) if (cells != spilling).any() else len(cells)
                if on:
                    yield _met(1, cells[:on], fps[:on])
                cells, fps = cells[on:], fps[on:]
                if not len(cells):
                    held = (cells, fps)
                    continue
                spilling = None
            if not len(cells):
                continue
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            sizes = np.diff(np.append(starts, len(cells)))
            hot = np.repeat(sizes > block, sizes)
            if hot.any():
                yield _met(1, cells[hot], fps[hot])
            last = starts[-1]
            if sizes[-1] > block:
                spilling, last = cells[-1], len(cells)
            done = ~hot & (np.arange(len(cells)) < last)
            if done.any():
                yield from compare(cells[done], fps[done])
            held = (cells[last:], fps[last:])
        if len(held[0]):
            yield from compare(*held)

    return run


def _meet_blocks(radius: int, segment_bits: int):
    """Stream rows sorted by (cell, low, high, fp): the members of one pair of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            a, b = grow_components(np.concatenate(held), radius, segment_bits)
            return _met(0, a, b)

        for batch in batches:
            keys = np.stack([batch[n].to_numpy(zero_copy_only=False).astype("i8") for n in ("cell", "low", "high")], axis=1)
            fps = batch["fp"].to_numpy(zero_copy_only=False).view("u8")
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if key is not None and key != tuple(keys[s]):
                    yield flush()
                    held = []
                key = tuple(keys[s])
                held.append(fps[s:e])
        if held:
            yield flush()

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS, block: int = BLOCK) -> DataFrame:
    """``(src, dst)``: links that join exactly the distinct fingerprints (column ``fp``) which links of up to
    ``radius`` bits join. Within a grid point a dense group gives links to one root, not all its pairs.

    A grid point with more than ``block`` fingerprints is cut into blocks by hash, and every pair of its
    blocks is a group of its own: no task holds more than two blocks, none is left out.
    """
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = fps.select("fp").mapInArrow(_to_cells(radius, segment_bits), CELLS)
    met = materialize(cells.repartition(parts, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_meet(radius, segment_bits, block), MET), "met")
    hot = met.where("hot = 1").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    blocks = hot.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("n"))
    mine = hot.join(blocks, "cell").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")))
    paired = mine.select("cell", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")).select(
        "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp"
    )
    more = paired.repartition(parts, "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "fp").mapInArrow(_meet_blocks(radius, segment_bits), MET)
    return met.where("hot = 0").unionByName(more).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: component_id is the smallest doc_id that links reach.

    Equal fingerprints meet as one; null and empty texts, and those of white space alone, have fingerprint zero and link
    like any other. Repeated rows come through each. A null doc_id links too, but is never the smallest
    (null where a component has no other). No rows give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(texts.mapInArrow(_fingerprints(shingle), FINGERPRINT), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    joined = connected_components(fingerprint_links(classes, radius))
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = rooted.join(least, "component").select("fp", "component_id")
    return marked.join(answer, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its component.

    Rows that repeat that doc_id all come through, and so does a component without any doc_id.
    """
    stay = near_duplicates(docs, shingle=shingle, radius=radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_stay")), "left_semi")


def fp_hex(fp: str):
    """16 lower-case hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", fp_hex("fp").alias("fingerprint"), "component_id")
