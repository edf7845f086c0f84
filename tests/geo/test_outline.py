"""Areas put together: T-shaped borders, islands, holes, touching corners, oblique sides; and areas filed under inner cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrajobs.functions import geo
from terrajobs.operators import cells, outline, spatial

SCHEMA = "name string, geometry " + geo.POLYGON.simpleString()


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [[ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def parts_of(row):
    return [[[(v["x"], v["y"]) for v in r] for r in part] for part in row["geometry"]]


def shoelace(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2


def test_t_shaped_border(spark):
    """The reviewed case: one area beside two stacked ones."""
    areas = frame(spark, [("a", box(0, 0, 1, 2)), ("b", box(1, 0, 2, 1)), ("c", box(1, 1, 2, 2))])
    edges = {tuple(r) for r in spatial.national_outline(areas).collect()}
    assert not any(e[0] == e[2] == 1 for e in edges) and sum(math.dist(e[:2], e[2:]) for e in edges) == 8
    (part,) = parts_of(outline.dissolve(areas).first())
    assert len(part) == 1 and shoelace(part[0]) == 4 and part[0][0] == part[0][-1]


def test_oblique_t_border(spark):
    """A vertex in the middle of a slanting side; rounded as coordinates are."""
    mid = (1 / 3, 1 / 7)
    areas = frame(spark, [("a", [[ring([(0, 0), (1, 3 / 7), (0, 1)])]]), ("b", [[ring([(0, 0), (0.5, -1), mid])]]), ("c", [[ring([mid, (0.5, -1), (1, 3 / 7)])]])])
    (part,) = parts_of(outline.dissolve(areas).first())
    assert len(part) == 1 and len(part[0]) == 5 and {(0.0, 0.0), (0.5, -1.0), (0.0, 1.0)} < set(part[0])


def test_islands_holes_and_lakes(spark):
    """A ring of eight boxes around a hole, an island in the hole, one elsewhere, and an area with a hole of its own that another fills."""
    around = [(f"r{i}{j}", box(i, j, i + 1, j + 1)) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    island, lake = ("island", box(1.25, 1.25, 1.75, 1.75)), ("lake", [box(10, 0, 14, 4)[0] + box(11, 1, 12, 2)[0] + box(12.5, 1, 13.5, 2)[0]])
    (row,) = outline.dissolve(frame(spark, [*around, island, lake, ("filled", box(11, 1, 12, 2)), ("none", None)])).collect()
    parts = parts_of(row)
    told = sorted((round(shoelace(p[0]), 9), [round(shoelace(h), 9) for h in p[1:]]) for p in parts)
    assert told == [(0.25, []), (9.0, [-1.0]), (16.0, [-1.0])]
    area, _, _ = geo.polygon_area_centroid(F.lit(0) if False else F.col("geometry"))
    assert frame(spark, [("x", row["geometry"])]).select(area).first()[0] == pytest.approx(8 + 0.25 + 15)


def test_corners_that_touch_and_groups(spark):
    rows = [("a", box(0, 0, 1, 1)), ("a", box(1, 1, 2, 2)), ("b", box(1, 0, 2, 1)), ("b", box(1, 0, 2, 1)), (None, box(0, 1, 1, 2))]
    got = {r["name"]: parts_of(r) for r in outline.dissolve(frame(spark, rows), by=["name"]).collect()}
    assert {k: sorted(shoelace(p[0]) for p in v) for k, v in got.items()} == {"a": [1, 1], "b": [1], None: [1]}
    (part,) = parts_of(outline.dissolve(frame(spark, rows)).first())
    assert len(part) == 1 and shoelace(part[0]) == 4


def test_turned_rings_and_nothing(spark):
    clockwise = [[list(reversed(box(0, 0, 1, 1)[0][0]))]]
    (part,) = parts_of(outline.dissolve(frame(spark, [("a", clockwise), ("b", box(1, 0, 2, 1))])).first())
    assert shoelace(part[0]) == 2
    assert outline.dissolve(frame(spark, [])).count() == 0 and outline.dissolve(frame(spark, [("x", None)]), by=["name"]).count() == 0


def test_tiles_of_random_rectangles(spark):
    """A rectangle cut again and again, so that borders meet in Ts everywhere, is whole again."""
    rng, tiles = random.Random(5), [(0.0, 0.0, 8.0, 4.0)]
    for _ in range(60):
        x0, y0, x1, y1 = tiles.pop(rng.randrange(len(tiles)))
        at = round(rng.uniform(0.2, 0.8), 3)
        cut = x0 + at * (x1 - x0) if x1 - x0 > y1 - y0 else y0 + at * (y1 - y0)
        tiles += [(x0, y0, cut, y1), (cut, y0, x1, y1)] if x1 - x0 > y1 - y0 else [(x0, y0, x1, cut), (x0, cut, x1, y1)]
    edges = spatial.national_outline(frame(spark, [(str(t), box(*t)) for t in tiles])).collect()
    assert sum(math.dist(e[:2], e[2:]) for e in edges) == pytest.approx(24) and all(e[0] == e[2] in (0, 8) or e[1] == e[3] in (0, 4) for e in edges)
    (part,) = parts_of(outline.dissolve(frame(spark, [(str(t), box(*t)) for t in tiles])).first())
    assert len(part) == 1 and shoelace(part[0]) == pytest.approx(32)


def inside(x, y, polygon):
    odd = False
    for part in polygon:
        for r in part:
            for a, b in zip(r, r[1:] + r[:1]):
                if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                    odd = not odd
    return odd


@pytest.mark.parametrize("side", [0.05, 0.7, 5.0])
def test_inner_cells_have_no_edges(spark, side):
    """Points of many-cornered areas with holes, by cells of several sizes; most cells of a fine grid need no edge."""
    rng = random.Random(9)
    star = lambda cx, cy, n, far: ring([(cx + far * (1 + 0.4 * (k % 3 == 0)) * math.cos(2 * math.pi * k / n), cy + far * (1 + 0.4 * (k % 3 == 0)) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    shapes = [("a", [[star(0, 0, 60, 2.0), star(0, 0, 9, 0.5)], [star(5, 5, 15, 1.0)]]), ("b", [[star(4.0, 0.3, 33, 1.1)]])]
    points = [(i, rng.uniform(-4, 7), rng.uniform(-4, 7)) for i in range(600)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r["id"], r["name"]) for r in cells.points_within(df, frame(spark, shapes), "geometry", ["name"], side).collect()}
    assert got == {(i, name) for i, x, y in points for name, shape in shapes if inside(x, y, shape)}
    filed = cells.area_cells(frame(spark, shapes), "geometry", side, ["name"])
    assert filed.where("inner AND edges IS NOT NULL").count() == 0
    if side == 0.05:
        assert filed.where("inner").count() > filed.where("NOT inner").count()
