import math
from collections import Counter

import numpy as np
import pytest

from terrajobs.llm import hard_negatives as op

from .common import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, row string, q int, planes string, anchor_id long, score double"


def row(vec_id, embedding, label):
    return (vec_id, embedding, label, "r", 1, "p", 5, 0.5)


def brute(rows):
    """(vec_id, embedding, label) rows: every anchor against every other row, in Python's integers."""
    usable = []
    for vec_id, embedding, label in rows:
        if vec_id is None or label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in embedding]))
    out = []
    for i, (anchor, own, a) in enumerate(usable):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), vec_id, j, label) for j, (vec_id, label, b) in enumerate(usable) if j != i)
        for p, positive, _, _ in [s for s in scored if s[3] == own][:5]:
            fits = [(n, v) for n, v, _, label in scored if label != own and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(anchor, positive, rank, v, -p, -n) for rank, (n, v) in enumerate(fits[:10], 1)]
    return Counter(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("dims", [8, 24])
def test_lookups_are_inner_products(dims):
    rng = np.random.default_rng(dims)
    a, c = (rng.integers(-300, 300, (n, dims)) for n in (5, 70))
    c[0], c[1] = -512, 511
    assert np.array_equal(op.look_up(op.subset_sums(a), op.bit_planes(c, 10)), c @ a.T)


def test_subset_sums_by_their_definition():
    a = np.arange(1, 17).reshape(1, 16) ** 2
    sums = op.subset_sums(a)
    assert sums.shape == (2, 256, 1)
    assert all(sums[g, m, 0] == sum(a[0, 8 * g + j] for j in range(8) if m >> (7 - j) & 1) for g in (0, 1) for m in range(256))


def test_best_takes_earlier_places_of_ties():
    scores = np.array([5, 9, 9, 1, 9, 5, 7])
    assert list(op.best(scores, np.array([0, 1, 2, 4, 5, 6]), 4)) == [1, 2, 4, 6] and list(op.best(scores, np.array([3, 5, 0]), 10)) == [5, 0, 3] and not len(op.best(scores, np.array([], int), 3))


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and got(op.op12_hard_negatives(spark, SMALL)) == want


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = got(op.mine(df))
    for name, value in (("ANCHORS_A_BLOCK", 2), ("ROWS_A_BLOCK", 37), ("AT_A_TIME", 5), ("TOGETHER", 1)):
        monkeypatch.setattr(op, name, value)
    assert got(op.mine(df.repartition(9))) == want


def test_awkward_rows(spark):
    """Nulls in any column, odd components, short and empty vectors, ties, repeated rows and ids, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25, 0.125], 1), (100, [0.5, 0.5], 1), (200, [], 2), (300, [nan, 1.0, 0.0], 1), (400, None, 1), (500, [1.0, None], 1), (None, [1.0, 1.0, 1.0], 1), (600, [1.0, inf], 1), (700, [0.5, 0.5, 0.0], None)]
    rows += [(i, [0.5, -0.001 * (i % 3), 0.25 * (i % 2)], i % 3) for i in range(1, 60)] + [(7, [0.5, 0.0, 0.25], 2)] * 3 + [(-100, [0.25, 0.0, -0.5], 2), (0, [0.5, -0.25, 0.125], 1), (99, [-0.5, -0.5, -0.5], 1)]
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    want = brute(rows)
    assert want and got(op.mine(df)) == want


def test_long_vectors_and_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 10, [float(x) for x in rng.normal(size=70) * 3000], i % 2) for i in range(60)]
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert got(op.mine(df)) == brute(rows)
    with pytest.raises(ValueError):
        op.mine(spark.createDataFrame([row(1, [1e30], 1)], SCHEMA))


def test_nothing_gives_nothing(spark):
    assert not got(op.mine(spark.createDataFrame([], SCHEMA)))
    assert not got(op.mine(spark.createDataFrame([row(100, [1.0], 1), row(1, [1.0], 1)], SCHEMA)))
    assert not got(op.mine(spark.createDataFrame([row(1, [1.0], 1), row(2, [1.0], 2)], SCHEMA)))
