import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from terrajobs.functions import geo
from terrajobs.operators import geocode, roads, spatial
from terrajobs.sources import tables


def polygon(*parts):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
ELBOW = [(10, 0), (14, 0), (14, 1), (11, 1), (11, 4), (10, 4)]
AREAS = [("holed", polygon([SQUARE, HOLE])), ("elbow and island", polygon([ELBOW], [[(20, 20), (21, 20), (20, 21)]])), ("beside", polygon([[(4, 0), (8, 0), (8, 4), (4, 4)]]))]


@pytest.fixture(scope="module")
def areas(spark):
    from pyspark.sql import types as T

    return spark.createDataFrame(AREAS, T.StructType([T.StructField("name", T.StringType()), T.StructField("geometry", geo.POLYGON)]))


def test_points_in_polygons(spark, areas):
    points = {(0.5, 0.5): "holed", (1.5, 1.5): None, (4.0, 2.0): None, (1.0, 1.5): None, (5.0, 1.0): "beside", (12.0, 0.5): "elbow and island", (12.0, 2.0): None, (20.2, 20.2): "elbow and island", (30.0, 30.0): None, (0.0, 0.0): None}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)] + [(99, None, 1.0)], "id int, lon double, lat double")
    for side in (0.3, 1.0, 50.0):
        got = {r["id"]: r["name"] for r in spatial.locate_points(df, areas, ["name"], side=side).collect()}
        assert got == dict(enumerate(points.values())) | {99: None}
    inside = spatial.points_in_areas(df, areas.where("name = 'holed'"), ["id"], side=1.0)
    assert [r["id"] for r in inside.collect()] == [0]


def test_range_joins_are_equi_joins(spark, areas):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double")
    plan = spatial.locate_points(df, areas, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_centroid_and_bounds(spark, areas):
    area, x, y = geo.polygon_area_centroid(F.col("geometry"))
    got = {r["name"]: (r["a"], r["x"], r["y"]) for r in areas.select("name", area.alias("a"), x.alias("x"), y.alias("y")).collect()}
    assert got["beside"] == pytest.approx((16, 6, 2))
    assert got["holed"] == pytest.approx((15, (16 * 2 - 1.5) / 15, (16 * 2 - 1.5) / 15))
    row = spatial.area_bounds(areas, source=4326, target=4326).first()
    assert tuple(row) == (0, 0, 21, 21)
    empty = spatial.area_bounds(areas.limit(0), source=4326, target=4326).first()
    assert tuple(empty) == (None,) * 4


def test_outline_cancels_shared_borders(spark, areas):
    edges = {tuple(r) for r in spatial.national_outline(areas.where("name <> 'elbow and island'")).collect()}
    assert (4.0, 0.0, 4.0, 4.0) not in edges and (0.0, 0.0, 4.0, 0.0) in edges and len(edges) == 3 + 4 + 3


@settings(max_examples=40, deadline=None)
@given(st.floats(6.5, 18.6), st.floats(36.0, 47.4))
def test_inverse_geodesic_agrees_with_small_arcs(lon, lat):
    metres = geo.inverse_geodesic(lon, lat, lon, lat + 0.001)
    assert 110 < metres < 112 and geo.inverse_geodesic(lon, lat, lon, lat) == 0


def test_projections(spark):
    """Round trips, the corner of the fixed map window, and sample centroids of two comuni in Piemonte."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(6.5, 18.6, 300), rng.uniform(36, 47.4, 300))], "lon double, lat double")
    for crs in (3857, 32632):
        x, y = geo.transform_crs(F.col("lon"), F.col("lat"), 4326, crs)
        back = df.withColumns({"x": x, "y": y})
        lon, lat = geo.transform_crs(F.col("x"), F.col("y"), crs, 4326)
        assert back.select(F.max(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))))).first()[0] < 1e-8
    lon, lat = geo.transform_crs(F.lit(404137.44847), F.lit(5024327.0), 32632, 4326)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(row["lat"] - 45.365898) < 1e-2 and abs(row["lon"] - 7.775889) < 1e-2
    with pytest.raises(ValueError):
        geo.transform_crs(F.lit(1), F.lit(1), 4326, 1234)


def test_radius():
    assert geo.radius_in_degrees(300) == pytest.approx(0.002744, abs=2e-6)
    assert geo.metres_to_degrees(1e9) == (1.0, 1.0)


def test_coordinate_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "Latitude double, LONGITUDE double, t string")
    assert spatial.find_coord_columns(df) == ("Latitude", "LONGITUDE")
    with pytest.raises(ValueError):
        spatial.find_coord_columns(df.drop("Latitude"))
    with pytest.raises(KeyError):
        spatial.find_coord_columns(df, "nope", "LONGITUDE")
    with pytest.raises(TypeError):
        spatial.find_coord_columns(df, "t", "LONGITUDE")


def test_population(spark):
    grid = spark.createDataFrame([(12.5, 41.9, 10.0), (12.501, 41.9, 5.0), (12.6, 41.9, 7.0)], "Lon float, Lat float, Population double")
    df = spark.createDataFrame([(1, 41.9, 12.5), (2, 45.0, 9.0), (3, None, 9.0)], "id int, lat double, lon double")
    got = {r["id"]: r["n_residents"] for r in spatial.population_nearby(df, grid, 300, "id").collect()}
    assert got == {1: 15.0, 2: 0.0, 3: 0.0}
    assert spatial.population_nearby(df.limit(0), grid, 300, "id").columns == ["id", "lat", "lon", "n_residents"]
    for bad, error in ((0, ValueError), ("300", TypeError)):
        with pytest.raises(error):
            spatial.population_nearby(df, grid, bad, "id")


def brute_clusters(points, close):
    root = {k: k for k in points}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in points:
        for b in points:
            if a < b and close(points[a], points[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in points}


@pytest.mark.parametrize("metric", ["degrees", "haversine"])
def test_clusters_against_union_find(spark, metric):
    rng = np.random.default_rng(4)
    points = {i: (float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(12, 12.4, 250), rng.uniform(41.8, 42.1, 250)))}
    points |= {900 + i: points[0] for i in range(5)}
    df = spark.createDataFrame([(k, y, x) for k, (x, y) in points.items()] + [(999, None, 1.0)], "id int, lat double, lon double")
    metres = 1500
    if metric == "degrees":
        r = geo.radius_in_degrees(metres)
        close = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < r * r
    else:

        def close(a, b):
            h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
            return 2 * geo.MEAN_RADIUS * math.asin(math.sqrt(h)) < metres

    got = {r["id"]: r["aggregation_code"] for r in spatial.cluster_by_distance(df, metres, "id", metric=metric).collect()}
    assert got == brute_clusters(points, close) | {999: None}
    summary = spatial.cluster_summary(spatial.cluster_by_distance(df, metres, "id", metric=metric)).first()
    assert summary["n_groups"] == len(set(brute_clusters(points, close).values()))


def test_clusters_of_the_worked_example(spark):
    rows = [(1, 42.000001, 12.000001), (2, 42.000002, 12.000002), (3, 42.001002, 12.001002), (4, 42.001002, 12.001002)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double")
    codes = lambda m: [r["aggregation_code"] for r in spatial.cluster_by_distance(df, m, "id").orderBy("id").collect()]
    assert codes(1000) == [1, 1, 1, 1] and codes(50) == [1, 1, 3, 3]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(7)
    exits = [(i, float(x), float(y), "Autostrada") for i, (x, y) in enumerate(zip(rng.uniform(6, 18, 40), rng.uniform(36, 47, 40)))]
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(zip(rng.uniform(0, 30, 60), rng.uniform(30, 60, 60)))]
    df, targets = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(exits, "id int, x double, y double, classificazione string")
    for n, side in ((1, 0.5), (3, 0.2), (50, 2.0)):
        got = {r["id"]: [e["id"] for e in r["exits"]] for r in spatial.nearest_exits(df, targets, "id", "lat", "lon", n, side).collect()}
        assert got == {p: [e[0] for e in sorted(exits, key=lambda e: ((lon - e[1]) ** 2 + (lat - e[2]) ** 2, e[0]))[:n]] for p, lat, lon in points}
    assert spatial.distance_to_highway(df, targets.limit(0), "id", "lat", "lon").where("distance_m IS NOT NULL").count() == 0


def test_highways_and_exits(spark):
    line = [{"x": 12.0, "y": 42.0}, {"x": 12.2, "y": 42.0}]
    features = [
        ("motorway", {"ref": "A 1", "name": "x", "name:it": "Sole"}, "LineString", line), ("motorway", {"ref": "A21racc"}, "LineString", line), ("motorway_link", {"int_ref": "E 80"}, "LineString", line),
        ("trunk", {"name": "Diramazione A21"}, "LineString", line), ("trunk", {"ref": "SS1"}, "LineString", [{"x": 12.0, "y": 43.0}, {"x": 12.2, "y": 43.0}]), ("trunk", {"ref": "A2"}, "Polygon", line),
    ]
    df = spark.createDataFrame(features, "type string, tags map<string,string>, shape string, geometry array<struct<x:double,y:double>>")
    roads_table = roads.classify_highways(df)
    assert [(r["id"], r["classificazione"], r["name"]) for r in roads_table.collect()] == [("A1", "Autostrada", "Sole"), ("A10", "Congiunzione autostradale", None), ("A21", "Autostrada", "Diramazione A21"), ("SS1", "Superstrada", None)]
    junctions = [(1, {"name": "Roma Nord"}, 12.1, 42.0), (2, {"name": "Uscita 5"}, 12.1, 42.0), (3, {"name": "Est"}, 12.1, 43.0), (4, {}, 12.05, 42.5), (5, {"name": "Svincolo via Appia"}, 12.1, 42.0), (6, {"name": "Area di Servizio"}, 12.1, 42.0)]
    exits = roads.classify_highway_exits(spark.createDataFrame(junctions, "id int, tags map<string,string>, x double, y double"), roads_table)
    assert sorted((r["id"], r["classificazione"]) for r in exits.collect()) == [(1, "Autostrada"), (3, "Superstrada")]
    points = spark.createDataFrame([(1, 42.0001, 12.1), (2, 42.1, 12.1), (3, None, 12.1)], "id int, lat double, lon double")
    assert {r["id"]: r["in_highway"] for r in spatial.points_on_highway(points, roads_table, "lat", "lon", 50).collect()} == {1: True, 2: False, 3: False}


def test_geocoding(spark):
    rows = [("Corso di Francia Roma", "Firenze"), ("Corso di Francia", "Roma"), ("Viale G. P. da Palestrina", "Latina"), ("Via dellAquila Reale", "Roma"), ("xxxx", None), ("Corso di Francia", "Roma")]
    df = spark.createDataFrame(rows, "address string, city string")
    places = [
        ("corso di francia roma, firenze", "Corso di Francia, Roma, Italia", 41.9, 12.4), ("corso di francia, roma", "Corso di Francia, Roma, Italia", 41.9, 12.4),
        ("viale giovanni pierluigi da palestrina, latina", "Viale Palestrina, Latina, Italia", 41.4, 12.9), ("Via dell'Aquila Reale", "Via dell'Aquila Reale, Roma, Italia", 41.8, 12.6),
    ]
    gazetteer = spark.createDataFrame(places, "address string, full_address string, latitude double, longitude double")
    pages = spark.createDataFrame([("<p>in Viale Giovanni Pierluigi da Palestrina a Latina</p>",)], "html string")
    got = [(r["address"], r["latitude"]) for r in geocode.geocode_addresses(df, gazetteer, "address", comune="city", pages=pages).collect()]
    assert sorted(got, key=str) == sorted([(rows[0][0], None), (rows[1][0], 41.9), (rows[1][0], 41.9), (rows[2][0], 41.4), (rows[3][0], 41.8), (rows[4][0], None)], key=str)
    none = geocode.geocode_addresses(df.limit(0), gazetteer, "address", comune="city")
    assert none.count() == 0 and none.columns == ["address", "city", "latitude", "longitude"]


def test_reverse_geocoding(spark):
    gazetteer = spark.createDataFrame([("Via Uno, Roma", "Roma", 41.9, 12.5), ("Via Due, Roma", "Roma", 41.95, 12.5)], "full_address string, city string, latitude double, longitude double")
    df = spark.createDataFrame([(41.901, 12.5, "mine"), (43.88, 8.89, "sea"), (None, 1.0, "none")], "lat double, lon double, city string")
    got = {r["city"]: (r["address"], r["city_geo"]) for r in geocode.reverse_geocode(df, gazetteer, "lat", "lon").collect()}
    assert got == {"mine": ("via uno, roma", "Roma"), "sea": (None, None), "none": (None, None)}


def test_crs_detection(spark):
    box = polygon([[(6, 36), (19, 36), (19, 48), (6, 48)]])
    from pyspark.sql import types as T

    country = spark.createDataFrame([(box,)], T.StructType([T.StructField("geometry", geo.POLYGON)]))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(7, 18, 200), rng.uniform(37, 47, 200))], "lon double, lat double")
    for crs in (4326, 32632, 3857):
        x, y = geo.transform_crs(F.col("lon"), F.col("lat"), 4326, crs)
        assert spatial.detect_crs(df.select(x.alias("x"), y.alias("y")), "x", "y", country) == crs
    assert spatial.detect_crs(df.limit(0).select(F.col("lon").alias("x"), F.col("lat").alias("y")), "x", "y", country) == 4326


def test_readers(spark, tmp_path):
    header = ";".join('"' + h.replace("\n", "\r\n") + '"' for h in tables.REGISTRY_COLUMNS)
    (tmp_path / "r.csv").write_bytes((header + "\r\n063049;Napoli;Napoli;063;Napoli;15;Campania;NA;Sud\r\n001001;Agliè;Agliè;001;Torino;1;Piemonte;TO;Nord-ovest\r\n").encode("latin-1"))
    rows = {r["codice_comune"]: r for r in tables.read_registry(spark, str(tmp_path / "r.csv")).collect()}
    assert rows["063049"]["sigla"] == "NA" and rows["001001"]["denominazione_comune"] == "Agliè"
    (tmp_path / "o.csv").write_text("ITTER107,TIME_PERIOD,OBS_VALUE\n001001,2021,5\nIT,2021,9\n001001,2020,4\n")
    read = lambda year, force=False: [tuple(r) for r in tables.read_istat_observations(spark, str(tmp_path / "o.csv"), year, "popolazione", force).collect()]
    assert read(2022) == [(1001, 5.0)] and read(2020, True) == [(1001, 4.0)] and read(2024) == []
    with pytest.raises(ValueError):
        read(2022, True)
    (tmp_path / "c.csv").write_bytes((";".join(tables.CHANGES_COLUMNS) + "\nA;B;2010-01-01;ES;testo;2010\nC;D;2015-01-01;CD;;2015\n").encode("latin-1"))
    assert tables.read_administrative_changes(spark, str(tmp_path / "c.csv"), 2012).count() == 1
    (tmp_path / "b.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"PRO_COM":7},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}},{"type":"Feature","properties":{"PRO_COM":8},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]]]]}}]}')
    shapes = {r["codice_comune"]: r for r in tables.read_boundaries(spark, str(tmp_path / "b.json"), "PRO_COM", "codice_comune").collect()}
    assert (shapes[7]["center_x"], shapes[7]["center_y"]) == (2.0, 2.0) and len(shapes[8]["geometry"]) == 2
    (tmp_path / "w.csv").write_text('code,wkt\n1,"MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((9 9, 10 9, 9 10, 9 9)))"\n2,"POINT (1 1)"\n')
    shapes = {r["k"]: r for r in tables.read_boundaries(spark, str(tmp_path / "w.csv"), "code", "k").collect()}
    assert [len(p) for p in shapes[1]["geometry"]] == [2, 1] and shapes[2]["geometry"] is None
    (tmp_path / "osm.json").write_text('{"elements":[{"id":1,"type":"way","tags":{"highway":"trunk","ref":"SS1"},"geometry":[{"lat":42,"lon":12},{"lat":42,"lon":13}]},{"id":2,"type":"node","lat":1,"lon":2,"tags":{"highway":"trunk"}},{"id":3,"type":"way","tags":{"highway":"other"}}]}')
    osm = tables.read_osm_features(spark, str(tmp_path / "osm.json"), ["trunk"]).orderBy("id").collect()
    assert [(r["id"], r["shape"]) for r in osm] == [(1, "LineString"), (2, "Point")]
    (tmp_path / "g.csv").write_text("Lon,Lat,Population\n12.5,41.9,1.25\n12.6,41.9,0.01\n")
    grid = tables.read_population_grid(spark, str(tmp_path / "g.csv"))
    assert [r["Population"] for r in grid.collect()] == [12] and tables.decode_population_grid(grid).first()["Population"] == 1.2


def test_simplify(spark, areas):
    ring = [(0, 0), (1, 0.01), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    from pyspark.sql import types as T

    df = spark.createDataFrame([(polygon([ring]),), (None,)], T.StructType([T.StructField("geometry", geo.POLYGON)]))
    out = df.select(geo.simplify_polygon(0.05)("geometry").alias("g")).collect()
    assert [(v["x"], v["y"]) for v in out[0]["g"][0][0]] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and out[1]["g"] is None
