"""NaN and infinite coordinates are missing ones in every job over points; odd cells of the sources."""

import math

import pytest
from pyspark.sql import functions as F

from terrajobs.functions import geo
from terrajobs.operators import geocode, maps, spatial
from terrajobs.sources import tables

NAN, INF = float("nan"), float("inf")
GOOD = [(i, 44.0 + i % 9 / 8, 9.0 + i // 9 / 8, float(i)) for i in range(81)]
BAD = [(900, NAN, 9.0, 1.0), (901, 44.0, NAN, 1.0), (902, INF, 9.0, 1.0), (903, 44.0, -INF, 1.0), (904, None, 9.0, 1.0), (905, NAN, NAN, 1.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, lat double, lon double, v double")


def area(spark):
    box = geo.box_polygon(*map(F.lit, (8.5, 43.5, 10.5, 45.5)))
    return spark.range(1).select(F.lit("box").alias("name"), box.alias("geometry"))


def grid(spark):
    return spark.createDataFrame([(9.0, 44.0, 3.0), (NAN, 44.0, 5.0), (9.0, INF, 5.0), (9.0, 44.0, NAN), (None, 44.0, 1.0)], "Lon double, Lat double, Population double")


def exits(spark):
    return spark.createDataFrame([(1, 9.0, 44.0, "Autostrada"), (2, NAN, 44.0, "Autostrada")], "id int, x double, y double, classificazione string")


def roads(spark):
    line = [{"x": 8.9, "y": 44.0}, {"x": 9.2, "y": 44.0}]
    return spark.createDataFrame([("Autostrada", line)], "classificazione string, geometry array<struct<x:double,y:double>>")


def gazetteer(spark):
    return spark.createDataFrame([("Via Roma 1", "Genova", 44.0, 9.0), ("Via Milano 1", "Genova", NAN, 9.0)], "full_address string, city string, latitude double, longitude double")


#: A job over all rows, and what of a row it says.
JOBS = {
    "to_points": (lambda s, df: spatial.to_points(df), "x"),
    "locate_points": (lambda s, df: spatial.locate_points(df, area(s), ["name"]), "name"),
    "points_in_areas": (lambda s, df: spatial.points_in_areas(df, area(s)), "id"),
    "population_nearby": (lambda s, df: spatial.population_nearby(df, grid(s), 500), "n_residents"),
    "cluster_by_distance": (lambda s, df: spatial.cluster_by_distance(df, 500, "id"), "aggregation_code"),
    "cluster_by_distance haversine": (lambda s, df: spatial.cluster_by_distance(df, 500, "id", metric="haversine"), "aggregation_code"),
    "points_on_highway": (lambda s, df: spatial.points_on_highway(df, roads(s), "lat", "lon"), "in_highway"),
    "distance_to_highway": (lambda s, df: spatial.distance_to_highway(df, exits(s), "id", "lat", "lon", ellipsoid=False), "distance_m"),
    "reverse_geocode": (lambda s, df: geocode.reverse_geocode(df, gazetteer(s), "lat", "lon"), "address"),
    "point_map_table": (lambda s, df: maps.point_map_table(df, "lat", "lon", ["id"]), "x"),
    "filter_bounds": (lambda s, df: spatial.filter_bounds(df, (8, 43, 12, 46), "lon", "lat"), "id"),
}
NOTHING = {"population_nearby": 0.0, "points_on_highway": False}


@pytest.mark.parametrize("job", JOBS)
def test_odd_points_are_missing_points(spark, job):
    run, column = JOBS[job]
    alone = {r["id"]: r[column] for r in run(spark, frame(spark, GOOD)).collect()}
    both = {r["id"]: r[column] for r in run(spark, frame(spark, GOOD + BAD)).collect()}
    assert {k: v for k, v in both.items() if k < 900} == alone and not any(isinstance(v, float) and math.isnan(v) for v in alone.values())
    assert all(both[k] == NOTHING.get(job) for k, *_ in BAD if k in both)


def test_density_grid_without_odd_points(spark):
    """The reviewed case: one NaN put every point into the first cells."""
    run = lambda rows, **o: sorted(tuple(r) for r in maps.density_grid(frame(spark, rows), "lon", "lat", nx=20, ny=20, **o).collect())
    assert run(GOOD + BAD) == run(GOOD) and len(run(GOOD)) > 100
    assert run(GOOD + BAD, interactive=True) == run(GOOD, interactive=True)
    odd = [(7, 44.5, 9.5, NAN), (8, 44.6, 9.5, INF), (9, 44.6, 9.4, None)]
    assert run(GOOD + odd, value="v") == run(GOOD + [(i, y, x, 0.0) for i, y, x, _ in odd], value="v")


def test_systems_and_bounds_without_odd_points(spark):
    assert spatial.detect_crs(frame(spark, GOOD + BAD * 200), "lon", "lat", area(spark)) == 4326
    odd = area(spark).withColumn("geometry", F.transform("geometry", lambda p: F.transform(p, lambda r: F.concat(r, F.array(F.struct(F.lit(NAN).alias("x"), F.lit(INF).alias("y")))))))
    assert tuple(spatial.area_bounds(odd, target=4326).first()) == (8.5, 43.5, 10.5, 45.5)


def test_bounds_of_what_is_asked_for(spark):
    rows = [("Como", "Como", "CO", "Lombardia", 13, 0.0), ("Livo", "Trento", "TN", "Trentino", 22, 2.0), ("Milano", "Milano", "MI", "Lombardia", 15, 4.0)]
    df = spark.createDataFrame(rows, "denominazione_comune string, denominazione_provincia string, sigla string, denominazione_regione string, codice_comune int, x double")
    areas = df.withColumn("geometry", geo.box_polygon(F.col("x"), F.col("x"), F.col("x") + 1, F.col("x") + 1)).drop("x")
    box = lambda **k: tuple(spatial.chosen_bounds(areas, target=4326, **k).first())
    assert box() == (0.0, 0.0, 5.0, 5.0) and box(regione="lombardia ") == (0.0, 0.0, 5.0, 5.0) and box(provincia="tn") == (2.0, 2.0, 3.0, 3.0)
    assert box(comune=["COMO", 22], provincia="MI", regione="Trentino") == (0.0, 0.0, 3.0, 3.0) and box(provincia=["Milano"], regione="Trentino") == (4.0, 4.0, 5.0, 5.0)
    for none in ({"comune": "Atlantide"}, {"provincia": []}, {"comune": "Atlantide", "regione": "Lombardia"}):
        with pytest.raises(ValueError):
            box(**none)
    with pytest.raises(ValueError):
        spatial.chosen_bounds(areas.limit(0))


def test_sources_with_odd_cells(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("ITTER107,TIME_PERIOD,OBS_VALUE\n001,2019,5.5\n002,2019-Q1,7\n003,2019,n.d.\n99999999999,2019,1\nIT,2019,9\n")
    rows = tables.read_istat_observations(spark, str(tmp_path / "obs.csv"), 2020, "v").collect()
    assert sorted((r["codice_comune"], r["v"]) for r in rows) == [(1, 5.5), (3, None)]
    header = ";".join(tables.CHANGES_COLUMNS)
    line = ";".join("x" if new != "anno" else "{}" for new in tables.CHANGES_COLUMNS.values())
    (tmp_path / "changes.csv").write_text("\n".join([header, line.format("2019"), line.format("s.d."), line.format("2030")]), encoding="latin-1")
    assert sorted((r["anno"] or 0) for r in tables.read_administrative_changes(spark, str(tmp_path / "changes.csv")).collect()) == [0, 2019, 2030]
    assert tables.read_administrative_changes(spark, str(tmp_path / "changes.csv"), until=2020).count() == 1
