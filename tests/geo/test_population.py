"""Discs as whole cells and border points, against the plain sum."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrajobs.functions import geo
from terrajobs.operators import spatial


def brute(points, grid, r):
    return {i: sum(p for gx, gy, p in grid if (x - gx) ** 2 + (y - gy) ** 2 < r * r) for i, y, x in points}


def answers(spark, points, grid, metres):
    df, g = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(grid, "Lon double, Lat double, Population double")
    return {r["id"]: r["n_residents"] for r in spatial.population_nearby(df, g, metres).collect()}


SHAPES = {
    "lattice": lambda rng: [(9 + i / 512, 44 + j / 512, float(rng.randint(1, 40))) for i in range(100) for j in range(60)],
    "scattered": lambda rng: [(9 + rng.random() / 5, 44 + rng.random() / 5, float(rng.randint(1, 40))) for _ in range(5000)],
    "town": lambda rng: [(9.1 + rng.gauss(0, 0.005), 44.1 + rng.gauss(0, 0.005), 1.0) for _ in range(3000)] + [(12.0, 40.0, 5.0), (-3.0, 50.0, 2.0)],
    "line": lambda rng: [(9.0, 44 + i / 2000, 2.0) for i in range(1000)],
    "one": lambda rng: [(9.1, 44.1, 3.0)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_brute_force(spark, shape):
    rng = random.Random(shape)
    grid = SHAPES[shape](rng)
    points = [(i, 44 + rng.random() / 5, 9 + rng.random() / 5) for i in range(25)] + [(100 + i, grid[i % len(grid)][1], grid[i % len(grid)][0]) for i in range(5)] + [(200, -10.0, -9.0)]
    for metres in (60, 1500, 9000):
        assert answers(spark, points, grid, metres) == brute(points, grid, geo.radius_in_degrees(metres)), metres


def test_points_at_the_very_radius_are_outside(spark):
    r = geo.radius_in_degrees(2000)
    grid = [(x, y, 1.0) for x, y in ((r, 0.0), (0.0, -r), (math.nextafter(r, 0), 0.0), (0.0, 0.0), (0.6 * r, 0.8 * r), (0.6 * r, math.nextafter(0.8 * r, 0) - 1e-9))]
    assert answers(spark, [(1, 0.0, 0.0)], grid, 2000) == brute([(1, 0.0, 0.0)], grid, r)


def test_pieces_grow_with_the_radius(spark):
    """Twice the radius takes about twice the pieces, not four times; the pieces are the disc, each cell once."""
    asked = spark.createDataFrame([(9.01, 44.02), (9.5, -44.3)], "x double, y double")
    counts = []
    for cells in (16, 32, 64):
        side, levels = 0.01 / 16, int(math.log2(2 * cells)) + 1
        whole, border = spatial.disc_pieces(asked, cells * side, side, levels)
        counts.append(whole.count() + border.count())
        single = whole.select("x", "y", "cy", F.explode(F.sequence(F.col("c") * F.pow(F.lit(2), "k").cast("long"), (F.col("c") + 1) * F.pow(F.lit(2), "k").cast("long") - 1)).alias("c"))
        both = single.unionByName(border.select("x", "y", "cy", "c"))
        assert both.count() == both.distinct().count()
        area = both.groupBy("x").count().agg(F.avg("count")).first()[0]
        assert math.pi * cells**2 < area < math.pi * (cells + 1.5) ** 2
    assert counts[1] < 2.6 * counts[0] and counts[2] < 2.6 * counts[1]
