"""Building the tables of areas: comuni, province, regioni, their changes and aliases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrajobs.functions.storage import delete, list_names, read_file, swap_file
from terrajobs.functions.text import clean_name

LEVELS = ("comune", "provincia", "regione")
PROVINCE_KEYS = (
    "denominazione_provincia", "denominazione_provincia_ita_straniera", "codice_provincia", "sigla", "codice_regione",
    "denominazione_regione", "denominazione_regione_ita_straniera", "area_geografica",
)
REGION_KEYS = ("denominazione_regione", "codice_regione", "denominazione_regione_ita_straniera", "area_geografica")
# Kinds of change that rename or dissolve a comune, and the notice of a second official name, which is none.
CHANGE_KINDS = ("ES", "CD")
SECOND_NAME_NOTICE = "accanto alla denominazione in lingua italiana"


def clean_registry(raw: DataFrame) -> DataFrame:
    """Codes as integers, bilingual names kept beside the Italian ones, and the sigla of Napoli mended.

    ``raw`` has the columns of ``sources.tables.read_registry``. A main name is what stands before ``/``.
    """
    out = raw.withColumns({c: F.col(c).try_cast("int") for c in ("codice_comune", "codice_provincia", "codice_regione")})
    for level in ("provincia", "regione"):
        full = f"denominazione_{level}"
        out = out.withColumns({f"{full}_ita_straniera": F.col(full), full: F.split(full, "/")[0]})
    lost = (F.lower("denominazione_provincia") == "napoli") & F.col("sigla").isNull()
    return out.withColumn("sigla", F.when(lost, F.lit("NA")).otherwise(F.col("sigla")))


def build_comuni(registry: DataFrame, population: DataFrame, area: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Registry with population (codice_comune, popolazione), area (codice_comune, superficie_km2) and shapes, by left joins.

    Rows of the joined tables without a code are left out first.
    """
    out = registry.join(population.where(F.col("codice_comune").isNotNull()), "codice_comune", "left")
    if shapes is not None:
        out = out.join(shapes.where(F.col("codice_comune").isNotNull()), "codice_comune", "left")
    return out.join(area.where(F.col("codice_comune").isNotNull()), "codice_comune", "left")


def _totals() -> list[Column]:
    return [F.coalesce(F.sum("popolazione"), F.lit(0)).cast("long").alias("popolazione"), F.coalesce(F.sum("superficie_km2"), F.lit(0.0)).alias("superficie_km2")]


def build_province(comuni: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Population and area by province. Sums of nothing are 0; a null sigla is a value, other null keys drop the row."""
    keys = [k for k in PROVINCE_KEYS if k in comuni.columns]
    known = comuni.dropna(subset=[k for k in keys if k != "sigla"])
    out = known.groupBy(*keys).agg(*_totals())
    return out if shapes is None else out.join(shapes, "codice_provincia", "left")


def build_regioni(comuni: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Population and area by region; rows with a null key are dropped."""
    keys = [k for k in REGION_KEYS if k in comuni.columns]
    out = comuni.dropna(subset=keys).groupBy(*keys).agg(*_totals())
    return out if shapes is None else out.join(shapes, "codice_regione", "left")


def hierarchy_rollup(comuni: DataFrame) -> DataFrame:
    """Population and area of every province, region, geographic area and the country, in one aggregation.

    ``level`` is the grouping id: 0 province, 1 region, 3 geographic area, 7 country.
    """
    return comuni.rollup("area_geografica", "denominazione_regione", "denominazione_provincia").agg(F.grouping_id().cast("long").alias("level"), *_totals())


def area_list(areas: DataFrame, level: str) -> DataFrame:
    """Names of a level's areas: of comuni all, of others each once."""
    name = f"denominazione_{_known(level)}"
    return areas.select(name) if level == "comune" else areas.select(name).distinct()


def _known(level: str) -> str:
    if level not in LEVELS:
        raise ValueError(f"level is one of {LEVELS}, not {level!r}")
    return level


#: Names, in a folder of reference tables, the version that counts.
CURRENT = "CURRENT"


def write_reference_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Write comuni, provincia and regione tables (and others by name) under a folder as Parquet; returns the version's name.

    All tables go into a folder of their own, and only when all are there does the folder's pointer change, in one step. A reader sees the old
    tables or the new ones, never some of each, and a job that dies leaves the old ones in place. The version before stays, for who still reads it;
    older ones, and what dead jobs left, go. One job at a time writes to a folder.
    """
    spark = next(iter(tables.values())).sparkSession
    last = read_file(spark, f"{folder}/{CURRENT}")
    version = f"v{0 if last is None else int(last.split('-')[0][1:]) + 1:06d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    swap_file(spark, f"{folder}/{CURRENT}", version)
    for name in list_names(spark, folder):
        if name.startswith("v") and name not in (version, last):
            delete(spark, f"{folder}/{name}")
    return version


def get_areas(spark: SparkSession, folder: str, level: str) -> DataFrame:
    """The table of a level, of the version that counts; an unknown level raises, and so does a folder without tables."""
    name, version = _known(level), read_file(spark, f"{folder}/{CURRENT}")
    if version is None:
        raise FileNotFoundError(f"no reference tables in {folder}")
    return spark.read.parquet(f"{folder}/{version}/{name}")


def filter_administrative_changes(changes: DataFrame) -> DataFrame:
    """Changes that renamed or dissolved a comune; notices of a second official name are none. Null text counts as empty."""
    text = F.coalesce("contenuto", F.lit(""))
    return changes.where(F.col("tipo_variazione").isin(*CHANGE_KINDS) & ~text.contains(SECOND_NAME_NOTICE))


def historic_name_map(changes: DataFrame) -> DataFrame:
    """``old_name -> new_name``, both cleaned: of several changes the earliest, a change without date first.

    Of equal dates the lesser new name.
    """
    rows = changes.select(clean_name("denominazione_comune").alias("old_name"), clean_name("new_denominazione_comune").alias("new_name"), F.to_date("data_decorrenza").alias("day"))
    dated = F.struct(F.coalesce("day", F.lit("0001-01-01").cast("date")), "new_name")
    return rows.where("new_name IS NOT NULL AND old_name IS NOT NULL").groupBy("old_name").agg(F.min_by("new_name", dated).alias("new_name"))


def bilingual_name_map(areas: DataFrame, name: str, full_name: str, dashes: bool = True) -> DataFrame:
    """``alias -> name``, both cleaned, of areas whose full name is not the Italian one.

    A full name is split on ``/``, else (``dashes``) on ``-``. Of two areas with the same alias the greater name counts.
    """
    full = F.col(full_name)
    parts = F.when(full.contains("/"), F.split(full, "/")).otherwise(F.split(full, "-") if dashes else F.array(full))
    rows = areas.where(~F.col(name).eqNullSafe(full)).select(F.explode(parts).alias("alias"), F.col(name).alias("name"))
    rows = rows.select(clean_name("alias").alias("alias"), clean_name("name").alias("name"))
    return rows.where("alias <> name").groupBy("alias").agg(F.max("name").alias("name"))
