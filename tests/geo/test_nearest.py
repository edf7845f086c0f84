"""Nearest neighbours where targets cluster, repeat or lie on lines."""

import random

import pytest
from pyspark.sql import functions as F

from terrajobs.operators import nearest


def answers(spark, points, targets, n, **options):
    p, t = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(targets, "t int, tx double, ty double")
    out = {}
    for r in nearest.nearest_points(p, "id", t, "t", n, **options).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["t"])
        assert r["rank"] == len(out[r["id"]])
    return out


def brute(points, targets, n, most=None):
    out = {}
    for i, x, y in points:
        near = sorted(((x - tx) ** 2 + (y - ty) ** 2, k) for k, tx, ty in targets)
        if found := [k for d, k in near if most is None or d <= most * most][:n]:
            out[i] = found
    return out


def town(rng, n):
    """All but one of the targets in one town, the last ten degrees away."""
    return [(i, 12.5 + rng.gauss(0, 0.01), 41.9 + rng.gauss(0, 0.01)) for i in range(n - 1)] + [(n - 1, 22.5, 41.9)]


SHAPES = {
    "town": lambda rng: town(rng, 3000),
    "towns in towns": lambda rng: [(i, 10 + rng.choice([0, 1e-3, 1]) + rng.random() * 10 ** -rng.randint(1, 9), 45 + rng.random() * 10 ** -rng.randint(1, 9)) for i in range(2000)],
    "line": lambda rng: [(i, 7.0, 40 + i / 500) for i in range(1500)],
    "one place": lambda rng: [(i, 7.0, 45.0) for i in range(300)],
    "two places": lambda rng: [(i, 7.0 + (i % 2), 45.0) for i in range(300)],
    "even": lambda rng: [(i, rng.uniform(7, 18), rng.uniform(36, 47)) for i in range(2500)],
    "one": lambda rng: [(5, 1.0, 1.0)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_brute_force(spark, shape):
    rng = random.Random(shape)
    targets = SHAPES[shape](rng)
    points = [(i, 12.5 + rng.gauss(0, 0.02), 41.9 + rng.gauss(0, 0.02)) for i in range(30)] + [(100 + i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(20)]
    points += [(200 + i, t[1], t[2]) for i, t in enumerate(targets[:10])] + [(300, 7.5, 45.0)]
    for n in (1, 3):
        assert answers(spark, points, targets, n) == brute(points, targets, n)
    assert answers(spark, points, targets, 2, most=0.5, side=0.01) == brute(points, targets, 2, 0.5)


def test_pairs_are_few_where_targets_cluster(spark):
    """The reviewed case: every point in the town met every target of it."""
    rng = random.Random(4)
    targets = town(rng, 20_000)
    points = [(i, 12.5 + rng.gauss(0, 0.01), 41.9 + rng.gauss(0, 0.01)) for i in range(500)]
    p, t = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(targets, "t int, tx double, ty double")
    box = t.agg(F.min("tx"), F.min("ty"), F.max("tx"), F.max("ty")).first()
    told, tables = nearest.placed(t, box, len(targets))
    most = told.groupBy(f"_leaf{tables - 1}").count().agg(F.max("count")).first()[0]
    met = nearest.candidates(p, "id", told, tables, 1)
    assert tables > 1 and most <= nearest.FEW and met.count() < 8 * nearest.FEW * len(points)
    assert met.groupBy("id").count().agg(F.max("count")).first()[0] < 1000


def test_missing_coordinates_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    targets = [(0, nan, 1.0), (1, 1.0, inf), (2, 5.0, 5.0), (3, None, 1.0), (4, 6.0, 6.0)]
    points = [(0, 5.1, 5.1), (1, nan, 5.0), (2, 5.0, -inf), (3, None, 5.0)]
    assert answers(spark, points, targets, 3) == {0: [2, 4]}
    assert answers(spark, points, [], 3) == {} and answers(spark, [], targets, 1) == {} and answers(spark, points, targets, 0) == {}


def test_points_meet_cells_by_blocks(spark, monkeypatch):
    """The reviewed case: every point met the cells of every table by itself."""
    import numpy as np

    z = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 5000))
    block = nearest._cut(np.concatenate([z, np.full(600, z[-1])]))
    assert (np.diff(block) != 0).sum() == len(set(block.tolist())) - 1 and np.bincount(block).max() <= nearest.BLOCK and len(set(block.tolist())) < 200
    monkeypatch.setattr(nearest, "CHUNK", nearest.FEW)
    rng = random.Random(5)
    points, targets = [(i, rng.uniform(7, 18), rng.uniform(36, 47)) for i in range(400)], [(i, rng.uniform(7, 18), rng.uniform(36, 47)) for i in range(3000)]
    assert answers(spark, points, targets, 3) == brute(points, targets, 3)
