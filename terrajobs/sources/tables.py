"""Readers of the source tables: CSV of statistics offices, GeoJSON or WKT boundaries, and dumps of map features."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.geo import ARROW_POLYGON, POLYGON, polygon_area_centroid

# Headers of the registry of comuni and of administrative changes, and the columns they become.
REGISTRY_COLUMNS = {
    "Codice Comune formato alfanumerico": "codice_comune",
    "Denominazione in italiano": "denominazione_comune",
    "Denominazione (Italiana e straniera)": "denominazione_comune_ita_straniera",
    "Codice Provincia (Storico)(1)": "codice_provincia",
    "Denominazione dell'Unità territoriale sovracomunale \n(valida a fini statistici)": "denominazione_provincia",
    "Codice Regione": "codice_regione",
    "Denominazione Regione": "denominazione_regione",
    "Sigla automobilistica": "sigla",
    "Ripartizione geografica": "area_geografica",
}
CHANGES_COLUMNS = {
    "Denominazione Comune": "denominazione_comune",
    "Denominazione Comune associata alla variazione o nuova denominazione": "new_denominazione_comune",
    "Data decorrenza validità amministrativa": "data_decorrenza",
    "Tipo variazione": "tipo_variazione",
    "Contenuto del provvedimento": "contenuto",
    "Anno": "anno",
}
#: Population is kept as whole tenths.
GRID_FACTOR = 10


def _squeeze(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip()


def _renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns by header, whatever white space a header holds; one that is missing raises."""
    there = {_squeeze(c): c for c in df.columns}
    missing = [c for c in columns if _squeeze(c) not in there]
    if missing:
        raise KeyError(f"no column {missing[0]!r}")
    return df.select(*(F.col(f"`{there[_squeeze(old)]}`").alias(new) for old, new in columns.items()))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The list of comuni: semicolons, Latin-1, a header with a line break; ``NA`` is the sigla of Napoli, not a null."""
    raw = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("multiLine", True).option("header", True).csv(path)
    return _renamed(raw, REGISTRY_COLUMNS)


def read_istat_observations(spark: SparkSession, path: str, year: int, value: str, force_year: bool = False) -> DataFrame:
    """``codice_comune, value`` of a year: that one when forced (raises without rows), else the last with rows of it and the two before.

    Periods that are no year leave their row out, values that are no number are null.
    """
    rows = spark.read.option("header", True).csv(path).select("ITTER107", F.col("TIME_PERIOD").try_cast("int").alias("t"), F.col("OBS_VALUE").try_cast("double").alias(value))
    rows = rows.where(F.col("ITTER107").rlike("^[0-9]+$")).withColumn("ITTER107", F.col("ITTER107").try_cast("int")).where("ITTER107 IS NOT NULL")
    last = rows.where(F.col("t").between(year if force_year else year - 2, year)).agg(F.max("t")).first()[0]
    if last is None and force_year:
        raise ValueError(f"no observations of {year}")
    return rows.where(F.col("t") == F.lit(last)).select(F.col("ITTER107").alias("codice_comune"), value)


def encode_population_grid(points: DataFrame) -> DataFrame:
    """Lon, Lat as floats and Population as whole tenths (half to even), rows above 0 only."""
    tenths = F.bround(F.col("Population").cast("double") * GRID_FACTOR, 0).cast("int")
    return points.select(F.col("Lon").cast("float").alias("Lon"), F.col("Lat").cast("float").alias("Lat"), tenths.alias("Population")).where("Population > 0")


def decode_population_grid(stored: DataFrame) -> DataFrame:
    """The grid with Population in people."""
    return stored.withColumn("Population", F.col("Population") / GRID_FACTOR)


def read_population_grid(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of Lon, Lat, Population in its stored form."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("Lon", "Lat", "Population")])
    return encode_population_grid(spark.read.schema(schema).option("header", True).csv(path))


def read_administrative_changes(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """Administrative changes, up to a year if one is given; a year that is no number is null."""
    raw = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("multiLine", True).option("header", True).csv(path)
    out = _renamed(raw, CHANGES_COLUMNS).withColumn("anno", F.col("anno").try_cast("int"))
    return out if until is None else out.where(F.col("anno") <= until)


def _polygon(coordinates, kind: str):
    parts = coordinates if kind == "MultiPolygon" else [coordinates]
    return [[[{"x": float(v[0]), "y": float(v[1])} for v in ring] for ring in part] for part in parts]


def parse_wkt(text: str | None):
    """A polygon from WKT POLYGON or MULTIPOLYGON; null otherwise."""
    if not text or not (m := re.match(r"\s*(MULTI)?POLYGON\s*(?:Z\s*)?(\(.*\))\s*$", text, re.I | re.S)):
        return None
    number = r"[-+0-9.eE]+"
    rings = lambda part: [[{"x": float(a), "y": float(b)} for a, b in re.findall(rf"({number})\s+({number})(?:\s+{number})?", ring)] for ring in re.findall(r"\(([^()]+)\)", part)]
    body = m[2][1:-1] if m[1] else m[2]
    parts = re.findall(r"\((?:\s*\([^()]+\)\s*,?)+\)", body)
    return [rings(p) for p in parts]


@F.arrow_udf(POLYGON)
def polygon_from_wkt(texts: pa.Array) -> pa.Array:
    return pa.array([parse_wkt(t) for t in texts.to_pylist()], ARROW_POLYGON)


def with_centroid(areas: DataFrame, polygon: str = "geometry") -> DataFrame:
    """``areas`` with center_x and center_y."""
    _, x, y = polygon_area_centroid(F.col(polygon))
    return areas.withColumns({"center_x": x, "center_y": y})


def read_boundaries(spark: SparkSession, path: str, code: str, name: str, lines: bool = False) -> DataFrame:
    """``name, geometry, center_x, center_y`` of a GeoJSON feature collection, or of a CSV with a ``wkt`` column.

    ``code`` is the property (or column) that holds the integer code. A JSON file is one collection and is read by one task, or (``lines``) it
    holds a collection a line and is split.
    """
    if path.endswith((".csv", ".csv.gz")):
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)
        return with_centroid(raw.select(F.col(code).try_cast("int").alias(name), polygon_from_wkt("wkt").alias("geometry")))
    feature = T.StructType(
        [
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
        ]
    )
    raw = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", not lines).json(path).select(F.explode("features").alias("f"))
    pairs = "array<array<array<double>>>"
    one = F.array(F.from_json("f.geometry.coordinates", pairs))
    many = F.from_json("f.geometry.coordinates", f"array<{pairs}>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    vertex = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    shape = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, vertex)))
    return with_centroid(raw.select(F.col("f.properties")[code].cast("double").cast("int").alias(name), shape.alias("geometry")))


def read_osm_features(spark: SparkSession, path: str, kinds: list[str], tag: str = "highway", lines: bool = False) -> DataFrame:
    """``id, type, tags, shape, geometry`` of the elements of a map dump (JSON with ``elements``) whose ``tag`` is one of ``kinds``.

    A way's geometry is its line, a node's a line of one vertex. A file is one dump and is read by one task, or (``lines``) it holds a dump (a
    tile) a line and is split.
    """
    vertex = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
    element = T.StructType(
        [
            T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()),
            T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.ArrayType(vertex)),
        ]
    )
    raw = spark.read.schema(T.StructType([T.StructField("elements", T.ArrayType(element))])).option("multiLine", not lines).json(path)
    rows = raw.select(F.explode("elements").alias("e")).select("e.*").where(F.col("tags")[tag].isin(*kinds))
    line = F.transform("geometry", lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y")))
    point: Column = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    shape = F.when(F.col("type") == "node", "Point").when(F.size("geometry") > 1, "LineString")
    return rows.select("id", F.col("tags")[tag].alias("type"), "tags", shape.alias("shape"), F.when(F.col("type") == "node", point).otherwise(line).alias("geometry"))
