"""Registered queries of the readers: derived tables are written in the form of each source to the shared folder and read from it.

Also the cross-level checks of the quality report, a pair of levels each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrajobs.functions import geo
from terrajobs.functions.storage import fresh_path
from terrajobs.jobs import queries as base
from terrajobs.jobs.derived import derive, duck
from terrajobs.operators import quality, registry
from terrajobs.sources import tables

QUERIES = {}
SQL = {}

#: Map features in a dump of one line.
TILE = 1000

query = base.registering(QUERIES, SQL)


def _csv(df: DataFrame, name: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


def _headed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(new).cast("string").alias(old) for old, new in headers.items()))


# --- statistics -------------------------------------------------------------------------------------------------------


@query(f"SELECT {', '.join(tables.REGISTRY_COLUMNS.values())} FROM {duck('registry_raw')}")
def read_registry(spark, d):
    raw = _headed(derive(spark, d, "registry_raw"), tables.REGISTRY_COLUMNS)
    return tables.read_registry(spark, _csv(raw, "registry", ";", "ISO-8859-1"))


#: An observation for each order, by its customer's code and its year, and totals of nations under letters.
_OBSERVED = """
    SELECT lpad(CAST(o_custkey + 1 AS STRING), 6, '0') AS ITTER107, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS TIME_PERIOD, CAST(o_totalprice AS DOUBLE) AS OBS_VALUE FROM {orders}
    UNION ALL SELECT 'IT' || CAST(n_nationkey AS STRING), 1999, 1E0 FROM {nation}"""
_OBSERVED_SQL = "(" + _OBSERVED.format(orders="orders", nation="nation") + ")"


def _observed(spark: SparkSession, d: str) -> str:
    used = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "nation")}
    return _csv(spark.sql(_OBSERVED, **used), "observations")


@query(
    f"SELECT CAST(ITTER107 AS INT) AS codice_comune, OBS_VALUE AS popolazione FROM {_OBSERVED_SQL} WHERE regexp_matches(ITTER107, '^[0-9]+$') AND TIME_PERIOD = "
    f"(SELECT max(TIME_PERIOD) FROM {_OBSERVED_SQL} WHERE regexp_matches(ITTER107, '^[0-9]+$') AND TIME_PERIOD BETWEEN 1997 AND 1999)"
)
def read_istat_observations(spark, d):
    """The last year up to 1999 that has observations of comuni."""
    return tables.read_istat_observations(spark, _observed(spark, d), 1999, "popolazione")


@query(f"SELECT CAST(ITTER107 AS INT) AS codice_comune, OBS_VALUE AS popolazione FROM {_OBSERVED_SQL} WHERE regexp_matches(ITTER107, '^[0-9]+$') AND TIME_PERIOD = 1995")
def read_istat_observations_of_year(spark, d):
    return tables.read_istat_observations(spark, _observed(spark, d), 1995, "popolazione", force_year=True)


@query(f"SELECT CAST(Lon AS FLOAT) AS Lon, CAST(Lat AS FLOAT) AS Lat, CAST(round_even(Population * 10, 0) AS INT) AS Population FROM {duck('grid')} WHERE Population > 0")
def read_population_grid(spark, d):
    return tables.read_population_grid(spark, _csv(derive(spark, d, "grid"), "grid"))


@query(
    "SELECT denominazione_comune, new_denominazione_comune, CAST(data_decorrenza AS VARCHAR) AS data_decorrenza, tipo_variazione, contenuto, CAST(year(data_decorrenza) AS INT) AS anno "
    f"FROM {duck('changes')} WHERE year(data_decorrenza) <= 1996"
)
def read_administrative_changes(spark, d):
    """Changes up to a year; those without one are left out."""
    raw = _headed(derive(spark, d, "changes").withColumn("anno", F.year("data_decorrenza")), tables.CHANGES_COLUMNS)
    return tables.read_administrative_changes(spark, _csv(raw, "changes", ";", "ISO-8859-1"), 1996)


@query(base.SQL["build_province"])
def get_areas(spark, d):
    """Province from the reference tables as they are written."""
    comuni = base._comuni(spark, d)
    folder = fresh_path(spark, "reference")
    registry.write_reference_tables({"comune": comuni, "provincia": registry.build_province(comuni), "regione": registry.build_regioni(comuni)}, folder)
    return registry.get_areas(spark, folder, "provincia")


# --- shapes -----------------------------------------------------------------------------------------------------------

_CORNERS = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
_SHAPES_SQL = f"SELECT CAST(codice AS INT) AS codice, CAST(5 AS INT) AS n_vertices, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y FROM {duck('boxes')}"


def _shapes(areas: DataFrame) -> DataFrame:
    v = geo.polygon_vertices(F.col("geometry"))
    bounds = (value.alias(name) for name, value in geo.polygon_bounds(F.col("geometry")).items())
    return areas.select("codice", F.size(v).alias("n_vertices"), *bounds, *(F.round(c, 6).alias(c) for c in ("center_x", "center_y")))


@query(_SHAPES_SQL)
def read_boundaries(spark, d):
    """A collection of features a region, a line each; polygons, and multipolygons of one part."""
    ring = F.to_json(F.array(F.array(*(F.array(x, y) for x, y in _CORNERS))))
    many = F.col("codice") % 2 == 1
    shape = F.concat(F.lit('{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(many, F.concat(F.lit("["), ring, F.lit("]"))).otherwise(ring), F.lit("}"))
    feature = F.concat(F.lit('{"properties":'), F.to_json(F.struct(F.col("codice").alias("COD"))), F.lit(',"geometry":'), shape, F.lit("}"))
    lines = derive(spark, d, "boxes").groupBy("denominazione_regione").agg(F.array_join(F.collect_list(feature), ",").alias("f"))
    path = fresh_path(spark, "boundaries")
    lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}"))).write.text(path)
    return _shapes(tables.read_boundaries(spark, path, "COD", "codice", lines=True))


@query(_SHAPES_SQL)
def read_boundaries_wkt(spark, d):
    corners = F.concat_ws(", ", *(F.concat_ws(" ", x, y) for x, y in _CORNERS))
    boxes = derive(spark, d, "boxes").select(F.col("codice").alias("COD"), F.concat(F.lit("POLYGON (("), corners, F.lit("))")).alias("wkt"))
    path = fresh_path(spark, "boundaries") + ".csv"
    boxes.write.option("header", True).csv(path)
    return _shapes(tables.read_boundaries(spark, path, "COD", "codice"))


@query(f"SELECT k AS id, type, ref, nome AS name, 'LineString' AS shape, x1, y1, x2, y2 FROM {duck('roads')} WHERE type IN ('motorway', 'trunk')")
def read_osm_features(spark, d):
    """Motorways and trunk roads of dumps of a thousand ways a line."""
    tags = F.create_map(*(F.lit(v) if i % 2 == 0 else F.col(v) for i, v in enumerate(("highway", "type", "ref", "ref", "name", "nome"))))
    vertex = lambda i: F.struct(F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat"))
    element: Column = F.struct(F.col("k").alias("id"), F.lit("way").alias("type"), F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"), F.array(vertex(1), vertex(2)).alias("geometry"))
    tiles = derive(spark, d, "roads").groupBy(F.floor(F.col("k") / TILE)).agg(F.collect_list(element).alias("elements"))
    path = fresh_path(spark, "features")
    tiles.select(F.to_json(F.struct("elements"))).write.text(path)
    found = tables.read_osm_features(spark, path, ["motorway", "trunk"], lines=True)
    ends = {f"{c}{i + 1}": F.col("geometry")[i][c] for i in (0, 1) for c in ("x", "y")}
    return found.select("id", "type", F.col("tags")["ref"].alias("ref"), F.col("tags")["name"].alias("name"), "shape", *(v.alias(k) for k, v in ends.items()))


# --- pairs of levels in the quality report ----------------------------------------------------------------------------


@query(
    base._WITH_DQ + f", q AS (SELECT id, {base._simple('nazione')} AS nazione, {base._simple('regione')} AS regione FROM rows), "
    f"italy AS (SELECT nazione AS it FROM q WHERE nazione IN {base._IT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    f"mr AS (SELECT regione, {base._simple('match_key')} AS fr FROM ({base.match_sql('regione', 'q', 'regione')})), "
    f"f AS (SELECT q.*, it, fr, coalesce(nazione IN {base._IT}, FALSE) AS inside, fr IS NOT NULL AND nazione IS DISTINCT FROM it AS told FROM q CROSS JOIN italy LEFT JOIN mr ON q.regione IS NOT DISTINCT FROM mr.regione) "
    "SELECT id, inside OR told AS is_in_italy, told OR (inside AND nazione <> it) AS nazione_check, CASE WHEN told OR (inside AND nazione <> it) THEN it END AS nazione_suggestion, "
    "(inside AND (regione IS NULL OR fr IS NULL)) OR (fr IS NOT NULL AND fr IS DISTINCT FROM regione) AS regione_check, CASE WHEN fr <> regione THEN fr END AS regione_suggestion FROM f"
)
def dq_cross_country(spark, d):
    """A known region tells that a row is in Italy, whatever its country says."""
    checked = base._dq(spark, d, quality.Columns(nazione="nazione", regione="regione", key="id"))
    return checked.select("id", "is_in_italy", "nazione_check", "nazione_suggestion", "regione_check", "regione_suggestion")


def _told_by(level: str, source: str) -> str:
    """check and suggestion of a level by what it says itself (found) and what a lower source tells (low)."""
    given = level if level == "comune" else base._simple(level)
    said = base._simple(f"q.{level}")
    named = f"SELECT x.{level}, {base._simple('n.name')} AS found FROM ({base.match_sql(level, 'q', level)}) x LEFT JOIN (SELECT DISTINCT codice_{level} AS code, denominazione_{level} AS name FROM comuni) n ON x.codice_{level} = n.code"
    if source == "coordinates":
        areas = base._DQ_AREAS.format(comuni="comuni", boxes=duck("boxes"))
        low = f"SELECT id, {base._simple(f'a.denominazione_{level}')} AS low FROM rows LEFT JOIN ({areas}) a ON longitudine > x0 AND longitudine < x1 AND latitudine > y0 AND latitudine < y1"
    else:
        low = f"SELECT r.id, {base._simple(f'c.denominazione_{level}')} AS low FROM rows r LEFT JOIN ({base.match_sql('comune', 'rows', 'comune')}) x ON r.comune IS NOT DISTINCT FROM x.comune LEFT JOIN comuni c ON x.codice_comune = c.codice_comune"
    return (
        base._WITH_DQ + f", q AS (SELECT id, {given} AS {level} FROM rows), m AS ({named}), low AS ({low}), "
        f"f AS (SELECT q.id, m.found, low.low, q.{level} IS NULL OR m.found IS NULL OR m.found <> {said} AS flag, CASE WHEN m.found <> {said} THEN m.found END AS said FROM q JOIN low ON q.id = low.id LEFT JOIN m ON q.{level} IS NOT DISTINCT FROM m.{level}) "
        f"SELECT id, flag OR (low IS NOT NULL AND (found IS NULL OR found <> low)) AS {level}_check, CASE WHEN low IS NOT NULL AND found IS NULL THEN low WHEN low <> found THEN NULL ELSE said END AS {level}_suggestion FROM f"
    )


def _pair(level: str, source: str) -> None:
    lower = {"latitudine": "latitudine", "longitudine": "longitudine"} if source == "coordinates" else {source: source}

    def run(spark, d):
        checked = base._dq(spark, d, quality.Columns(**{level: level}, **lower, key="id"))
        return checked.select("id", f"{level}_check", f"{level}_suggestion")

    run.__name__ = f"dq_cross_{level}_{source}"
    query(_told_by(level, source))(run)


_pair("regione", "comune")
for _level in quality.LEVELS:
    _pair(_level, "coordinates")
