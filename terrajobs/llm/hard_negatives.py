"""Hard negatives by exact integer scores from tables of subset sums (the method of the Four Russians).

A vector of integers is eight dimensions to a group. For an anchor, each group has a table of 256 sums: one for every subset of its eight
components. A candidate is its bit planes: for each binary digit of its components, from the sign down, a byte a group that says
which of the eight have that digit. A score is then, plane by plane, the sum of the looked-up sums, doubled from one plane to the
next: lookups, shifts and additions, and no digit is lost.

Anchors and candidates are dealt into blocks, and every block of anchors meets every block of candidates in a task of its own, first
within a label, for the positives, then across labels, for the negatives. Of each meeting the best few of an anchor remain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrajobs.functions.storage import drop, materialize

#: Components are floor(SCALE * x).
SCALE = 256
#: Anchors are rows whose id this divides; rows whose id SHIFTED divides have their label moved on by one, of LABELS.
ANCHOR_EVERY, SHIFTED, LABELS = 100, 7, 10
#: Positives of an anchor and negatives of a positive; percent of the positive's score between which a negative's lies.
POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 5, 10, 30, 90
#: Anchors and candidates of a block at most, on the average; anchors whose tables are looked up together, and candidates at a time (for the cache).
ANCHORS_A_BLOCK, ROWS_A_BLOCK, TOGETHER, AT_A_TIME = 4096, 65_536, 64, 1024


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, q``: rows that take part, with integer components.

    Rows without id or label, and vectors that are null or have a null or non-finite component, take no part.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~odd)
    return there.select("vec_id", "label", F.transform(vector, lambda x: F.floor(SCALE * x.cast("double"))).alias("q"))


def shifted_label(vec_id: Column, label: Column) -> Column:
    return F.when(vec_id % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of those of a group's eight components whose bits it has, the first being the highest bit."""
    n, dims = anchors.shape
    of_group = anchors.reshape(n, dims // 8, 8).transpose(1, 2, 0)
    sums = np.zeros((dims // 8, 1, n), anchors.dtype)
    for j in range(7, -1, -1):
        sums = np.concatenate([sums, sums + of_group[:, j : j + 1]], axis=1)
    return sums


def bit_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups): the bytes of each binary digit of the components in two's complement, the sign first."""
    return np.stack([np.packbits((q >> k) & 1 == 1, axis=1) for k in range(bits - 1, -1, -1)], axis=1)


def look_up(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the inner products, from an anchor's subset sums and a candidate's bit planes."""
    out = np.zeros((len(planes), sums.shape[2]), sums.dtype)
    one = np.empty_like(out)
    for k in range(planes.shape[1]):
        out += out
        for g in range(len(sums)):
            np.take(sums[g], planes[:, k, g], axis=0, out=one, mode="clip")
            # The highest digit of two's complement counts against the others.
            (np.subtract if k == 0 else np.add)(out, one, out=out)
    return out


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(vectors: DataFrame, dims: int, bits: int) -> DataFrame:
    """``row, vec_id, label, planes``: the bit planes of every vector as bytes."""

    def run(batches):
        for batch in batches:
            planes = bit_planes(_matrix(batch.column("q"), dims), bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label")), pa.array([p.tobytes() for p in planes], pa.binary())], ["row", "vec_id", "label", "planes"])

    return vectors.mapInArrow(run, vectors.select("row", "vec_id", "label", F.lit(b"").alias("planes")).schema)


def best(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Those of the places ``among`` that have the ``n`` highest scores, highest first, the earlier place of equals."""
    of = scores[among]
    if len(among) > n:
        # All ties with the n-th stay until they are put in order.
        stay = of >= np.partition(of, len(of) - n)[len(of) - n]
        among, of = among[stay], of[stay]
    return among[np.argsort(-of, kind="stable")[:n]]


def _meet(anchors: pa.Table, candidates: pa.Table, dims: int, bits: int, narrow: bool):
    """Candidates in the order of ties, and for each anchor (its number, scores of all candidates)."""
    order = np.lexsort([candidates.column(c).to_numpy() for c in ("row", "vec_id")])
    planes = np.frombuffer(b"".join(candidates.column("planes").to_pylist()), np.uint8).reshape(len(order), bits, dims // 8)[order]
    q = _matrix(anchors.column("q"), dims).astype(np.int32 if narrow else np.int64)

    def scored():
        for start in range(0, len(q), TOGETHER):
            sums = subset_sums(q[start : start + TOGETHER])
            parts = [look_up(sums, planes[i : i + AT_A_TIME]).T for i in range(0, len(planes), AT_A_TIME)]
            for j, scores in enumerate(np.concatenate(parts, axis=1)):
                yield start + j, scores.astype(np.int64)

    return order, scored()


def _blocks(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_rows: int, keys: list[str]):
    """Both sides grouped by block of anchors and block of candidates (within ``keys``), each block being sent to all of the other side."""
    partitions = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_anchors = -(-n_anchors // ANCHORS_A_BLOCK)
    of_rows = max(-(-n_rows // ROWS_A_BLOCK), min(partitions, -(-n_rows // AT_A_TIME)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = [*keys, "a_block", "c_block"]
    left = anchors.withColumn("a_block", dealt(of_anchors)).withColumn("c_block", every(of_rows))
    right = candidates.withColumn("c_block", dealt(of_rows)).withColumn("a_block", every(of_anchors))
    return left.groupBy(*by).cogroup(right.groupBy(*by))


_FOUND = "anchor_row long, nth int, row long, vec_id long, score long"


def _found(rows: list) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["anchor_row", "nth", "row", "vec_id", "score"])


def _first(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest of each anchor (and positive), with ``rank``."""
    order = Window.partitionBy("anchor_row", "nth").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(rows: DataFrame, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, vector``.

    Rows that ``usable_vectors`` leaves out take no part. A shorter vector counts as if it ended in zeros; repeated rows are rows of their own,
    each the other's neighbour; ties go by smaller id. An anchor without other rows of its label has no rows, nor has a
    positive without a negative between the two shares. Components so large that a score might not fit in 64 bits raise. Other columns are not looked at; no rows give none.
    """
    usable = usable_vectors(rows, vector)
    vectors = materialize(usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), shifted_label(F.col("vec_id"), F.col("label")).alias("label"), "q"), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    n_rows, n_anchors, dims, low, high = vectors.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    dims, reach = max(8, -(-(dims or 0) // 8) * 8), max(abs(low or 0), abs(high or 0))
    if dims * (reach + 1) ** 2 >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    bits, narrow = reach.bit_length() + 1, dims * (reach + 1) ** 2 < 1 << 30
    anchors = vectors.where(is_anchor).withColumnsRenamed({"vec_id": "anchor_id"})
    candidates = materialize(packed(vectors, dims, bits), "planes")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of an anchor's own label."""
        out = []
        if len(left) and len(right):
            order, scored = _meet(left, right, dims, bits, narrow)
            row, vec_id, own = right.column("row").to_numpy()[order], right.column("vec_id").to_numpy()[order], left.column("row").to_numpy()
            for i, scores in scored:
                out += [(own[i], 0, row[j], vec_id[j], scores[j]) for j in best(scores, np.flatnonzero(row != own[i]), positives)]
        return _found(out)

    blocks = max(1, n_anchors)
    same = _blocks(anchors.select("label", "row", "q"), candidates, blocks, max(1, n_rows), ["label"]).applyInArrow(near, _FOUND)
    positive = materialize(_first(same, positives).select(F.col("anchor_row").alias("_anchor"), F.col("rank").alias("_nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positive.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct("_nth", "positive_score"))).alias("positives"))
    asking = anchors.join(scores, F.col("row") == F.col("_anchor")).select("row", F.col("label").alias("own_label"), "q", "positives.positive_score")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of other labels between the shares of each positive's score."""
        out = []
        if len(left) and len(right):
            order, scored = _meet(left, right, dims, bits, narrow)
            row, vec_id, label = (right.column(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
            own, own_label, asked = left.column("row").to_numpy(), left.column("own_label").to_numpy(), left.column("positive_score").to_pylist()
            for i, scores in scored:
                other = label != own_label[i]
                for nth, p in enumerate(asked[i], 1):
                    fits = other & (scores >= -(-least * p // 100)) & (scores <= most * p // 100)
                    out += [(own[i], nth, row[j], vec_id[j], scores[j]) for j in best(scores, np.flatnonzero(fits), negatives)]
        return _found(out)

    across = _blocks(asking, candidates, blocks, max(1, n_rows), []).applyInArrow(hard, _FOUND)
    negative = materialize(_first(across, negatives), "negatives")
    drop(candidates)
    told = negative.join(positive, (F.col("anchor_row") == F.col("_anchor")) & (F.col("nth") == F.col("_nth"))).join(anchors.select(F.col("row").alias("_row"), "anchor_id"), F.col("anchor_row") == F.col("_row"))
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own_label, b.vec_id AS other_id, b.label AS other_label, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM s WHERE own_label = other_label) WHERE nth <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE s.own_label <> s.other_label AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
