"""Edges of the geographic jobs: dense cells, poles and the date line, far points, repeated rows, clashing columns, geometries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrajobs.functions import geo
from terrajobs.operators import maps, nearest, quality, spatial


def haversine(a, b):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.MEAN_RADIUS * math.asin(min(1.0, math.sqrt(h)))


def components(points, close):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if close(points[i], points[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(points))]


def blobs(seed):
    """Dense clouds some of which are linked by single pairs, and rows of points at nearly the distance."""
    rng = random.Random(seed)
    out = []
    for cx, cy in ((9.0, 45.0), (9.04, 45.0), (9.0, 45.05), (9.2, 45.2)):
        out += [(cx + rng.uniform(-0.012, 0.012), cy + rng.uniform(-0.012, 0.012)) for _ in range(60)]
    return out + [(8.5 + i * 0.0137, 44.5) for i in range(30)]


@pytest.mark.parametrize("few", [1, 4096])
def test_clusters_of_dense_cells_against_brute_force(spark, few):
    pts = blobs(1)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lon double, lat double")
    r = geo.radius_in_degrees(1500)
    for metric, close in (("degrees", lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < r * r), ("haversine", lambda a, b: haversine(a, b) < 1500)):
        got = {x["id"]: x["aggregation_code"] for x in spatial.cluster_by_distance(df, 1500, "id", metric=metric, few=few).collect()}
        assert [got[i] for i in range(len(pts))] == components(pts, close)


def test_clusters_at_the_poles_and_the_date_line(spark):
    pts = [(179.99999, 10.0), (-179.99999, 10.0), (0.0, 89.9999), (180.0, 89.9999), (90.0, 89.99), (-37.0, -90.0), (12.0, -90.0), (0.0, 88.5), (0.5, 88.5), (0.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(99, None, 1.0)], "id int, lon double, lat double")
    got = {x["id"]: x["aggregation_code"] for x in spatial.cluster_by_distance(df, 1600, "id", metric="haversine").collect()}
    assert [got[i] for i in range(len(pts))] == components(pts, lambda a, b: haversine(a, b) < 1600) and got[99] is None
    assert got[1] == 0 and got[3] == 2 and got[6] == 5 and got[8] == 7


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 45.0, 9.0, 5.0), (1, 45.0, 9.0, 5.0), (1, 46.0, 9.0, 6.0), (2, None, 9.0, 7.0), (3, 45.00001, 9.0, 8.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, x double").withColumns({c: F.lit(1) for c in ("y", "name", "aggregation_code", "n_residents", "address", "latitude", "_a", "cx", "edges")})
    grid = spark.createDataFrame([(9.0, 45.0, 3.0)], "Lon double, Lat double, Population double")
    area = spark.createDataFrame([("box", 8.0, 44.0, 10.0, 45.5)], "name string, a double, b double, c double, d double").withColumn("geometry", geo.box_polygon(*map(F.col, "abcd")))
    for _ in range(2):
        df = spatial.population_nearby(df, grid, 100, latitude="lat", longitude="lon")
        df = spatial.cluster_by_distance(df, 100, "id", latitude="lat", longitude="lon")
        df = spatial.locate_points(df, area, ["name"], latitude="lat", longitude="lon")
    out = df.collect()
    assert len(out) == len(rows) and len({c.lower() for c in df.columns}) == len(df.columns)
    assert sorted((r["x"], r["n_residents_new_new"], r["name_new"]) for r in out) == [(5.0, 3.0, "box"), (5.0, 3.0, "box"), (6.0, 0.0, None), (7.0, 0.0, None), (8.0, 3.0, "box")]
    assert all(r["aggregation_code"] == 1 and r["n_residents"] == 1 for r in out)
    table = maps.point_map_table(df, "lat", "lon", ["x", "name"])
    assert table.columns == ["x", "name", "lat", "lon", "x_new", "y"] and sorted(r["x"] for r in table.collect()) == [5.0, 5.0, 6.0, 8.0]
    assert spatial.points_in_areas(df, area, latitude="lat", longitude="lon").count() == 3


def test_geometries_and_systems(spark):
    area = spark.createDataFrame([("west", 6.0, 44.0, 9.0, 47.0), ("east", 9.0, 44.0, 13.0, 47.0)], "name string, a double, b double, c double, d double").withColumn("geometry", geo.box_polygon(*map(F.col, "abcd")))
    utm = area.withColumn("geometry", geo.transform_polygon(F.col("geometry"), 4326, 32632))
    points = spark.createDataFrame([(i, 7.0 + i * 0.1, 45.0 + i * 0.03) for i in range(50)], "id int, lon double, lat double")
    want = {i: "west" if 7.0 + i * 0.1 < 9.0 else "east" for i in range(50) if i != 20}
    got = {r["id"]: r["name"] for r in spatial.locate_points(points, utm, ["name"], crs=32632).collect()}
    assert {i: got[i] for i in want} == want  # 20 lies on the border, which bends in the other system
    e, n = geo.transform_crs(F.col("lon"), F.col("lat"), 4326, 32632)
    elsewhere = points.select("id", e.alias("lon"), n.alias("lat"))
    found = {r["id"]: r["name"] for r in spatial.locate_points(elsewhere, area, ["name"], points_crs=None).collect()}
    assert {i: found[i] for i in want} == want
    shown = maps.point_map_table(elsewhere, "lat", "lon", ["id"], areas=area.where("name = 'west'"), crs=32632)
    assert {r["id"] for r in shown.collect()} - {20} == {i for i, v in want.items() if v == "west"}
    shapes = points.select("id", geo.box_polygon(F.col("lon") - 0.01, F.col("lat") - 0.01, F.col("lon") + 0.01, F.col("lat") + 0.01).alias("geometry"))
    located = {r["id"]: r["name_of"] for r in spatial.locate_points(shapes, area.withColumnRenamed("name", "name_of"), ["name_of"]).collect()}
    assert {i: located[i] for i in want if i not in (19, 21)} == {i: v for i, v in want.items() if i not in (19, 21)}
    spots = points.select("id", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    placed = spatial.to_points(spots, geometry="p")
    assert placed.columns == ["id", "p", "x", "y"] and placed.count() == 50
    with pytest.raises(TypeError):
        spatial.to_points(points, geometry="lon")


def test_far_points_meet_bins_and_not_all_targets(spark):
    rng = random.Random(2)
    targets = [(i, rng.uniform(8, 10), rng.uniform(44, 46)) for i in range(400)]
    points = [(i, rng.uniform(8, 10), rng.uniform(44, 46)) for i in range(20)] + [(20 + i, rng.choice([-170.0, 0.0, 60.0, 9.0]), rng.uniform(-80, 20)) for i in range(30)]
    t, p = spark.createDataFrame(targets, "t int, tx double, ty double"), spark.createDataFrame(points, "id int, x double, y double")
    for n in (1, 3):
        out = spatial.nearest_points(p, "id", t, "t", n)
        got = {}
        for r in out.orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["t"])
        assert got == {i: [k for _, k in sorted(((x - tx) ** 2 + (y - ty) ** 2, k) for k, tx, ty in targets)][:n] for i, x, y in points}
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    rest = p.where("id >= 20")
    told, tables = nearest.placed(t, (8.0, 44.0, 10.0, 46.0), len(targets))
    met = nearest.candidates(rest, "id", told, tables, 1)
    assert met.count() < 0.3 * rest.count() * len(targets)


@pytest.fixture(scope="module")
def livos(spark):
    rows = [("Livo", "Como", "CO", "Lombardia", 6, 13), ("Livo", "Trento", "TN", "Trentino-Alto Adige", 7, 22), ("Milano", "Milano", "MI", "Lombardia", 1, 15)]
    return spark.createDataFrame(rows, "denominazione_comune string, denominazione_provincia string, sigla string, denominazione_regione string, codice_comune int, codice_provincia int")


def test_homonyms_in_quality_checks(spark, livos):
    rows = [(1, "Lombardia", "Como", "Livo"), (2, "Trentino-Alto Adige", "Trento", "Livo"), (3, "Lombardia", "provincia di Como", "Livo"), (4, "Lombardia", "Milano", "Livo"), (5, "Lombardia", "Como", "Milano")]
    df = spark.createDataFrame(rows, "id int, regione string, provincia string, comune string")
    out = {r["id"]: r for r in quality.dq_check(df, quality.Columns(regione="regione", provincia="provincia", comune="comune", key="id"), livos, only_warnings=False).collect()}
    assert not out[1]["check"] and not out[2]["check"] and len(out) == len(rows)
    assert out[3]["provincia_suggestion"] == "como" and not out[3]["comune_check"] and not out[3]["regione_check"]
    assert out[4]["provincia_check"] and out[5]["provincia_check"] and not out[5]["comune_check"]


def test_homonyms_on_the_map(spark, livos):
    df = spark.createDataFrame([("Livo", "Como", 5), ("Livo", "Trento", 7), ("livo ", "Trento", 2), ("Livo", None, 100), ("x", None, 9), (None, None, 9), ("frazione alta", "Como", 30)], "c string, p string, v int")
    gazetteer = spark.createDataFrame([("Frazione Alta", "Frazione Alta, Livo, Como, Lombardia, Italia", 0)], "name string, address string, rank int")
    held = {r["codice_comune"]: r["v"] for r in maps.choropleth_table(df, "c", "v", livos, "comune", parent="p", gazetteer=gazetteer).collect()}
    assert held == {6: 35, 7: 109, 1: 0}
    plain = {r["codice_comune"]: r["v"] for r in maps.choropleth_table(df, "c", "v", livos, "comune").collect()}
    assert plain == {6: 0, 7: 114, 1: 0}


def test_no_distance_without_coordinates(spark):
    row = spark.range(1).select(geo.haversine_m(F.lit(9.0), F.lit(None).cast("double"), F.lit(9.0), F.lit(45.0)).alias("a"), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("b")).first()
    assert row["a"] is None and abs(row["b"] - math.pi * geo.MEAN_RADIUS) < 1
