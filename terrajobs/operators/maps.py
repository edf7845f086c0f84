"""The tables behind choropleths, point maps and density grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from terrajobs.functions.columns import free_names, keyed, meets
from terrajobs.functions.geo import finite, transform_crs
from terrajobs.functions.storage import materialize
from terrajobs.functions.text import clean_name, human_format
from terrajobs.operators.matching import filter_areas, match_areas  # noqa: F401  filter_areas is of the maps' interface too
from terrajobs.operators.spatial import detect_crs, point_columns, points_within

# Weights of a Gaussian of sigma 1 at distances -4 to 4, before they are made to sum to 1.
SMOOTHING = tuple(math.exp(-k * k / 2) for k in range(-4, 5))
# Areas whose labels are black whatever their value.
DARK_LABELS = ("calabria", "liguria")
LEVELS = ("regione", "provincia", "comune")


def _area_key(mapping: DataFrame, areas: DataFrame, level: str) -> tuple[str, str]:
    """(column of the mapping, column of the areas) that tell areas apart: the code, or the name where there is none."""
    code = f"codice_{level}"
    return (code, code) if code in mapping.columns and code in areas.columns else ("match_key", f"denominazione_{level}")


def _matched(rows: DataFrame, given: list[str], mapping: DataFrame, at: str, keep: list[str]) -> DataFrame:
    """Rows that match, with ``_area`` and the columns ``keep``."""
    known = keyed(mapping.where(F.col("match_key").isNotNull()).select(*given, F.col(at).alias("_area")), given)
    return rows.join(known, meets([rows[g] for g in given])).select("_area", *(rows[k] for k in keep))


def choropleth_table(
    df: DataFrame, tag: str, value: str, areas: DataFrame, level: str, *, parent: str | None = None, similar: bool = False, gazetteer: DataFrame | None = None,
    pages: DataFrame | None = None, **aliases,
) -> DataFrame:
    """Every area of a level with the total of ``value`` over the rows whose ``tag`` matches it; 0 without rows.

    Rows without tag are left out. Totals are taken by tag (and parent) before names are matched, so matching sees distinct tags
    alone. Comuni are also found as localities of a gazetteer or of pages; ``similar`` accepts the most similar name. Areas are met
    by code, so of comuni that share a name each has its own rows, and the map's sum is that of the rows that match.
    """
    given = [tag] + ([parent] if parent else [])
    total = free_names(["_total"], df.columns)["_total"]
    totals = materialize(df.where(F.col(tag).isNotNull()).groupBy(*given).agg(F.sum(value).alias(total)), "totals")
    mapping = match_areas(totals, tag, areas, level, parent=parent, similar=similar, gazetteer=gazetteer, pages=pages, **aliases)
    at, on = _area_key(mapping, areas, level)
    by_area = _matched(totals, given, mapping, at, [total]).groupBy("_area").agg(F.sum(total).alias("_value"))
    out = free_names([value], areas.columns)[value]
    return areas.join(by_area, F.col(on) == F.col("_area"), "left").select(*(areas[c] for c in areas.columns), F.coalesce("_value", F.lit(0)).alias(out))


def choropleth_categories(df: DataFrame, tag: str, value: str, areas: DataFrame, level: str, *, check: bool = True, **aliases) -> DataFrame:
    """Every area with its text value and ``color``, the value's rank by frequency from 0 (the lesser value of equals first).

    Two values for one area raise.
    """
    said = df.where(F.col(tag).isNotNull() & F.col(value).isNotNull()).select(tag, value).distinct()
    mapping = match_areas(said, tag, areas, level, **aliases)
    at, on = _area_key(mapping, areas, level)
    by_area = _matched(said, [tag], mapping, at, [value]).groupBy("_area").agg(F.min(value).alias("_value"), F.count_distinct(value).alias("_n"))
    if check and (twice := by_area.where("_n > 1").limit(1).collect()):
        raise ValueError(f"{twice[0]['_area']} has several values")
    ranks = by_area.groupBy(F.col("_value").alias("_v")).count().withColumn("_color", F.row_number().over(Window.orderBy(F.desc("count"), "_v")) - 1).drop("count")
    ranked = by_area.join(ranks, F.col("_value") == F.col("_v")).select("_area", "_value", "_color")
    out = free_names([value, "color"], areas.columns)
    return areas.join(ranked, F.col(on) == F.col("_area"), "left").select(*(areas[c] for c in areas.columns), F.col("_value").alias(out[value]), F.col("_color").alias(out["color"]))


def choropleth_table_multi(df: DataFrame, tag: str, values: list[str], areas: DataFrame, level: str, **aliases) -> DataFrame:
    """Every area with several values of the rows that match it, not added up; missing numbers are 0, missing text ``-``."""
    mapping = match_areas(df, tag, areas, level, **aliases)
    at, on = _area_key(mapping, areas, level)
    rows = _matched(df, [tag], mapping, at, values).toDF("_area", *(f"_v{i}" for i in range(len(values))))
    numeric = {v for v in values if isinstance(df.schema[v].dataType, T.NumericType)}
    named = free_names(values, areas.columns)
    filled = (F.coalesce(F.col(f"_v{i}"), F.lit(0) if v in numeric else F.lit("-")).alias(named[v]) for i, v in enumerate(values))
    return areas.join(rows, F.col(on) == F.col("_area"), "left").select(*(areas[c] for c in areas.columns), *filled)


def parent_overlays(parents: DataFrame, areas: DataFrame, level: str) -> DataFrame:
    """The areas of a higher level that hold some of ``areas``."""
    name = f"denominazione_{level}"
    return parents.join(areas.select(name).distinct(), name, "left_semi")


def map_labels(table: DataFrame, name: str, value: str, percent: bool = False) -> DataFrame:
    """``name, value, label, color`` of the areas with a value above 0: in short form, or as a share of the total in percent.

    Labels are white above the middle of the range; two small dark areas are black always.
    """
    whole = Window.partitionBy(F.lit(0))  # the areas of one level
    v, total = F.col(value), F.sum(value).over(whole)
    text = F.concat(F.format_string("%.1f", F.bround(v / F.when(total != 0, total) * 100, 1)), F.lit("%")) if percent else human_format(v.cast("double"))
    middle = (F.max(value).over(whole) + F.min(value).over(whole)) / 2
    color = F.when(F.lower(F.col(name)).isin(*DARK_LABELS) | (v <= middle), "black").otherwise("white")
    return table.select(name, value, text.alias("label"), color.alias("color")).where(v > 0)


def point_map_table(
    df: DataFrame, latitude: str | None, longitude: str | None, info: list[str], *, areas: DataFrame | None = None, crs: int | None = 4326, polygon: str = "geometry", side: float | None = None,
    geometry: str | None = None,
) -> DataFrame:
    """``lat, lon`` in degrees, ``x, y`` in EPSG 3857 and the info columns of points, those within ``areas`` if given.

    ``crs`` is the points' system; None detects it by the areas. Info columns keep their values and names; those of the new columns that they have
    get ``_new``.
    """
    kind = {c: finite(F.col(c).cast("double")) for c in (latitude, longitude) if c is not None}
    px, py = (kind[longitude], kind[latitude]) if len(kind) == 2 and geometry is None else point_columns(df, latitude, longitude, geometry)
    points = df.select(*info, px.alias("_px"), py.alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL")
    if crs is None:
        crs = detect_crs(points, "_px", "_py", areas, polygon)
    lon, lat = transform_crs(F.col("_px"), F.col("_py"), crs, 4326)
    points = points.withColumns({"_lon": lon, "_lat": lat})
    if areas is not None:
        inside = points_within(points.select("_lon", "_lat").distinct(), areas, polygon, [], side, "_lon", "_lat").distinct()
        points = points.join(inside, ["_lon", "_lat"], "left_semi")
    x, y = transform_crs(F.col("_lon"), F.col("_lat"), 4326, 3857)
    named = free_names(["lat", "lon", "x", "y"], info)
    return points.select(*info, F.col("_lat").alias(named["lat"]), F.col("_lon").alias(named["lon"]), x.alias(named["x"]), y.alias(named["y"]))


def color_domain(df: DataFrame, value: str, interactive: bool = False) -> DataFrame:
    """One row: the range of colours of a column. Numbers: low, high; text: the number of values and the palette's size, 10 or 20.

    On still maps the low end lies a fifth of the range below the least value; on interactive ones the range is 0 to the
    maximum, or plus and minus the largest magnitude where values are negative.
    """
    if not isinstance(df.schema[value].dataType, T.NumericType):
        return df.agg(F.count_distinct(value).alias("n_values")).withColumn("palette", F.when(F.col("n_values") <= 10, 10).otherwise(20))
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    ends = df.agg(low.alias("a"), high.alias("b"))
    if not interactive:
        return ends.select((F.col("a") - (F.col("b") - F.col("a")) / 5).alias("low"), F.col("b").alias("high"))
    reach = F.greatest(F.abs("a"), F.abs("b"))
    return ends.select(F.when(F.col("a") < 0, -reach).otherwise(0.0).alias("low"), F.when(F.col("a") < 0, reach).otherwise(F.col("b")).alias("high"))


def density_grid(df: DataFrame, x: str, y: str, value: str | None = None, nx: int = 1000, ny: int = 1000, *, interactive: bool = False, dense: bool = False) -> DataFrame:
    """``ix, iy, z``: the smoothed log of weight by cell of an (nx - 1) by (ny - 1) histogram over the points' box.

    Weights are values from 1e-5 up (or 1), scaled to sum to 10000 (interactive: to a maximum of 10000); z at or below 0 is null
    (interactive: 0). Only cells that points reach take part, for log 1 is 0: a sum by cell, then two passes of nine taps with
    reflection at the borders. ``dense`` adds the other cells. Points with a NaN or infinite coordinate are left out, such values count as missing. A box without width or height raises.
    """
    weight = F.greatest(finite(F.col(value).cast("double")), F.lit(1e-5)) if value else F.lit(1.0)
    points = df.select(finite(F.col(x).cast("double")).alias("px"), finite(F.col(y).cast("double")).alias("py"), weight.alias("w")).where("px IS NOT NULL AND py IS NOT NULL")
    box = points.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.sum("w").alias("total"), F.max("w").alias("top")).first()
    if box["x0"] is None:
        return points.select(F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(0.0).alias("z"))
    if box["x0"] == box["x1"] or box["y0"] == box["y1"]:
        raise ValueError("the points' box has no width or no height")

    def bin_of(col: str, low: float, high: float, n: int) -> Column:
        return F.least(F.floor((F.col(col) - low) / (high - low) * (n - 1)), F.lit(n - 2)).cast("int")

    scale = 10000.0 / (box["top"] if interactive else box["total"])
    cells = points.select(bin_of("px", box["x0"], box["x1"], nx).alias("ix"), bin_of("py", box["y0"], box["y1"], ny).alias("iy"), "w").groupBy("ix", "iy").agg(F.log(F.sum("w") * F.lit(scale)).alias("z"))

    def smooth(cells: DataFrame, axis: str, n: int) -> DataFrame:
        total = sum(SMOOTHING)
        taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("g")) for k, w in zip(range(-4, 5), SMOOTHING, strict=True)))
        spread = cells.withColumn("t", F.explode(taps))
        # A cell gives to the one k away; what passes a border comes back from it, as often as it takes in a small grid.
        at = F.pmod(F.col(axis) + F.col("t.k"), F.lit(2 * n))
        spread = spread.withColumn(axis, F.when(at >= n, 2 * n - 1 - at).otherwise(at).cast("int"))
        return spread.groupBy("ix", "iy").agg(F.sum(F.col("z") * F.col("t.g")).alias("z"))

    out = smooth(smooth(cells, "ix", nx - 1), "iy", ny - 1)
    out = out.withColumn("z", F.when(F.col("z") > 0, F.col("z")).otherwise(F.lit(0.0) if interactive else F.lit(None).cast("double")))
    if dense:
        spark = df.sparkSession
        everything = spark.range((nx - 1) * (ny - 1)).select((F.col("id") / (ny - 1)).cast("int").alias("ix"), (F.col("id") % (ny - 1)).cast("int").alias("iy"))
        out = everything.join(out, ["ix", "iy"], "left")
        if interactive:
            out = out.withColumn("z", F.coalesce("z", F.lit(0.0)))
    return out
