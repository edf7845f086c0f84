import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from terrajobs.functions import geo
from terrajobs.operators import maps, quality, registry, spatial
from terrajobs.streaming.batches import enrich_stream

COMUNI = [("Milano", "Milano", "MI", "Lombardia", 1, 9.0, 45.0), ("Como", "Como", "CO", "Lombardia", 2, 9.0, 46.0), ("Roma", "Roma", "RM", "Lazio", 3, 12.0, 41.0), ("Forlì", "Forlì-Cesena", "FC", "Emilia-Romagna", 4, 12.0, 44.0)]


@pytest.fixture(scope="module")
def comuni(spark):
    df = spark.createDataFrame(COMUNI, "denominazione_comune string, denominazione_provincia string, sigla string, denominazione_regione string, codice_comune int, x double, y double")
    box = geo.box_polygon(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)
    return df.withColumn("geometry", box).withColumns({"popolazione": F.col("codice_comune") * 10, "superficie_km2": F.lit(1.5), "codice_provincia": F.col("codice_comune"), "codice_regione": F.lit(1), "area_geografica": F.lit("Nord")})


ROWS = [
    (1, "Italia", "Lombardia", "Milano", "Milano", 45.5, 9.5),  # all right
    (2, "ITALY", "Lombardia", "Milano", "Milano", 45.5, 9.5),  # odd spelling of the country
    (3, "Italia", None, "Milano", "Milano", 45.5, 9.5),  # region missing, known from the province
    (4, "Italia", "Lombardia", "Como", "Milano", 45.5, 9.5),  # province and comune disagree
    (5, "Italia", "Lombardia", "Milano", "Milanoo", 45.5, 9.5),  # misspelled comune, known from the point
    (6, "Italia", "Lazio", "Roma", "Roma", None, None),  # no coordinates
    (7, "Italia", "Lazio", "Roma", "Roma", 45.5, 9.5),  # coordinates in another comune
    (8, "Francia", "Ile", "Paris", "Paris", 48.8, 2.3),  # foreign row
    (9, "Francia", "Lombardia", "Paris", "Paris", 48.8, 2.3),  # foreign country, Italian region
    (10, "Italia", "Lombardy", "provincia di Milano", "comune di milano", 45.5, 9.5),  # other spellings
]
FIELDS = ("nazione", "regione", "provincia", "comune")
C = quality.Columns(*FIELDS, "latitudine", "longitudine", "id")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, nazione string, regione string, provincia string, comune string, latitudine double, longitudine double")


def test_report(spark, comuni, rows):
    out = {r["id"]: r for r in quality.dq_check(rows, C, comuni, areas=comuni, only_warnings=False, side=1.0).collect()}
    flags = lambda i: {f for f in (*FIELDS, "coordinates") if out[i][f"{f}_check"]}
    said = lambda i: {f: out[i][f"{f}_suggestion"] for f in FIELDS if out[i][f"{f}_suggestion"]}
    assert flags(1) == set() and out[1]["check"] is False and out[1]["solved"] is None
    assert flags(2) == {"nazione"} and said(2) == {"nazione": "italia"} and out[2]["solved"]
    assert flags(3) == {"regione"} and said(3) == {"regione": "lombardia"} and out[3]["solved"]
    assert flags(4) == {"provincia"} and said(4) == {} and out[4]["solved"] is False
    assert flags(5) == {"comune"} and said(5) == {"comune": "milano"} and out[5]["solved"]
    assert flags(6) == {"coordinates"} and out[6]["solved"] is False
    assert flags(7) == {"regione", "provincia", "comune"} and said(7) == {}
    assert flags(8) == set()
    assert "nazione" in flags(9) and said(9)["nazione"] == "italia"
    assert flags(10) == {"regione", "provincia", "comune"} and said(10) == {"regione": "lombardia", "provincia": "milano", "comune": "milano"} and out[10]["solved"]


def test_warnings_and_summary(spark, comuni, rows):
    checked = quality.dq_check(rows, C, comuni, areas=comuni, only_warnings=False, side=1.0)
    assert quality.dq_check(rows, C, comuni, areas=comuni, side=1.0).count() == checked.where("check").count()
    summary = {r["field"]: r for r in quality.dq_summary(checked, C).collect()}
    assert summary["*"]["n_rows"] == 10 and summary["*"]["n_problems"] == 8 and summary["coordinates"]["n_problems"] >= 1
    none = quality.dq_check(rows.limit(0), C, comuni, areas=comuni, side=1.0)
    assert none.count() == 0 and {"check", "solved", "comune_suggestion"} <= set(none.columns)
    assert {r["field"]: r["n_rows"] for r in quality.dq_summary(none, C).collect()}["*"] == 0


def test_unique_key(spark):
    quality.assert_unique_key(spark.createDataFrame([(1,), (2,)], "k int"), "k")
    with pytest.raises(ValueError):
        quality.assert_unique_key(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_choropleths(spark, comuni):
    regioni = comuni.select("denominazione_regione").distinct()
    df = spark.createDataFrame([("lombardia", 5, "a"), ("Lombardy", 2, "a"), ("Lazio ", 1, "b"), (None, 9, "c"), ("nowhere", 9, "d")], "reg string, v int, t string")
    got = {r["denominazione_regione"]: r["v"] for r in maps.choropleth_table(df, "reg", "v", regioni, "regione").collect()}
    assert got == {"Lombardia": 7, "Lazio": 1, "Emilia-Romagna": 0}
    near = spark.createDataFrame([("milanoo", 3), ("Rma", 1)], "c string, v int")
    got = {r["denominazione_comune"]: r["v"] for r in maps.choropleth_table(near, "c", "v", comuni.select("denominazione_comune"), "comune", similar=True).collect()}
    assert got["Milano"] == 3 and got["Roma"] == 1
    cats = {r["denominazione_regione"]: (r["t"], r["color"]) for r in maps.choropleth_categories(df, "reg", "t", regioni, "regione").collect()}
    assert cats == {"Lombardia": ("a", 0), "Lazio": ("b", 1), "Emilia-Romagna": (None, None)}
    with pytest.raises(ValueError):
        maps.choropleth_categories(df.union(spark.createDataFrame([("lombardia", 1, "z")], df.schema)), "reg", "t", regioni, "regione")
    multi = maps.choropleth_table_multi(df, "reg", ["v", "t"], regioni, "regione").collect()
    assert sorted((r["denominazione_regione"], r["v"], r["t"]) for r in multi) == [("Emilia-Romagna", 0, "-"), ("Lazio", 1, "b"), ("Lombardia", 2, "a"), ("Lombardia", 5, "a")]


def test_filters_and_bounds(spark, comuni):
    names = lambda **k: sorted(r["denominazione_comune"] for r in maps.filter_areas(comuni, **k).collect())
    assert names(regione="LOMBARDIA ") == names(regione=["lombardia"]) == ["Como", "Milano"]
    assert names(provincia="mi") == ["Milano"] == names(provincia=["Milano"]) and names(comune="forli") == ["Forlì"] == names(comune="4") and len(names()) == 4
    assert names(regione="lazio", comune="como") == ["Roma"]
    one, two = (tuple(spatial.area_bounds(maps.filter_areas(comuni, comune=c)).first()) for c in ("Como", ["como", "roma"]))
    assert one != two and one == tuple(spatial.area_bounds(maps.filter_areas(comuni, comune=["CoMo"])).first())
    over = maps.parent_overlays(comuni.select("denominazione_regione").distinct(), maps.filter_areas(comuni, comune="como"), "regione")
    assert [r[0] for r in over.collect()] == ["Lombardia"]


def test_labels_and_colours(spark):
    df = spark.createDataFrame([("A", 0), ("B", 40), ("C", 60), ("Liguria", 100)], "n string, v int")
    assert {r["n"]: (r["label"], r["color"]) for r in maps.map_labels(df, "n", "v", percent=True).collect()} == {"B": ("20.0%", "black"), "C": ("30.0%", "white"), "Liguria": ("50.0%", "black")}
    assert tuple(maps.color_domain(df, "v").first()) == (-20.0, 100.0) and tuple(maps.color_domain(df, "v", interactive=True).first()) == (0.0, 100.0)
    assert tuple(maps.color_domain(df.withColumn("v", F.col("v") - 70), "v", interactive=True).first()) == (-70.0, 70.0)
    assert tuple(maps.color_domain(df, "n").first()) == (4, 10)


@pytest.mark.parametrize("interactive", [False, True])
@pytest.mark.parametrize("n", [3, 4, 25])
def test_density_against_numpy(spark, interactive, n):
    rng = np.random.default_rng(n)
    pts = [(float(a), float(b), float(v)) for a, b, v in zip(rng.normal(12, 1, 300), rng.normal(42, 1, 300), rng.uniform(-1, 5, 300))]
    w = np.maximum([p[2] for p in pts], 1e-5)
    w = w / (w.max() if interactive else w.sum()) * 10000
    h, _, _ = np.histogram2d([p[0] for p in pts], [p[1] for p in pts], bins=n - 1, weights=w)
    z = np.log(np.where(h == 0, 1, h))
    k = np.array(maps.SMOOTHING) / sum(maps.SMOOTHING)
    for axis in (0, 1):
        padded = np.pad(z, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        z = sum(k[i] * np.take(padded, range(i, i + n - 1), axis=axis) for i in range(9))
    z = np.where(z <= 0, 0.0 if interactive else np.nan, z)
    df = spark.createDataFrame(pts, "x double, y double, v double")
    got = np.full((n - 1, n - 1), -1.0)
    for r in maps.density_grid(df, "x", "y", "v", n, n, interactive=interactive, dense=True).collect():
        got[r["ix"], r["iy"]] = np.nan if r["z"] is None else r["z"]
    assert np.allclose(got, z, atol=1e-9, equal_nan=True)


def test_density_needs_a_box(spark):
    with pytest.raises(ValueError):
        maps.density_grid(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y", nx=5, ny=5)
    assert maps.density_grid(spark.createDataFrame([], "x double, y double"), "x", "y", nx=5, ny=5).count() == 0


def test_point_map(spark, comuni):
    df = spark.createDataFrame([("a", "45.5", "9.5"), ("b", "41.5", "12.5"), ("c", None, "1")], "n string, lat string, lon string")
    out = maps.point_map_table(df, "lat", "lon", ["n"], areas=maps.filter_areas(comuni, regione="Lombardia"), side=1.0).collect()
    assert [(r["n"], r["lat"], r["lon"]) for r in out] == [("a", 45.5, 9.5)] and math.isclose(out[0]["x"], math.radians(9.5) * 6378137)


def test_registry_sums(spark, comuni, tmp_path):
    province = {r["denominazione_provincia"]: r["popolazione"] for r in registry.build_province(comuni).collect()}
    assert province == {"Milano": 10, "Como": 20, "Roma": 30, "Forlì-Cesena": 40}
    lost = comuni.withColumn("sigla", F.when(F.col("sigla") != "RM", F.col("sigla"))).withColumn("popolazione", F.lit(None).cast("int"))
    rows = registry.build_province(lost).collect()
    assert len(rows) == 4 and all(r["popolazione"] == 0 for r in rows)
    registry.write_reference_tables({"comune": comuni}, str(tmp_path))
    assert registry.get_areas(spark, str(tmp_path), "comune").count() == 4
    with pytest.raises(ValueError):
        registry.get_areas(spark, str(tmp_path), "stato")


def test_stream_of_batches(spark, comuni, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 45.5, 9.5), (2, 0.0, 0.0)], "id int, lat double, lon double").write.parquet(str(source / "a"))
    stream = spark.readStream.schema("id int, lat double, lon double").option("recursiveFileLookup", True).parquet(str(source))
    query = enrich_stream(stream, lambda b: spatial.locate_points(b, comuni, ["denominazione_comune"], side=1.0), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert {r["id"]: r["denominazione_comune"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "Milano", 2: None}
