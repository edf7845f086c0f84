"""Spatial joins, proximity and clusters.

Every join is an equi-join on grid cells, with the exact predicate after it: areas (or the smaller side of a radius join) are
filed under all cells that they touch, points under one, so a pair meets once.
"""

from __future__ import annotations

from itertools import product
from math import log2, pi, sin

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from terrajobs.functions.columns import attach, free_names
from terrajobs.functions.geo import (
    MEAN_RADIUS, POLYGON, finite, geodesic_distance_m, haversine_m, polygon_area_centroid, radius_in_degrees, segment_distance2, transform_crs,
)
from terrajobs.functions.graph import connected_components
from terrajobs.functions.storage import materialize
from terrajobs.operators.cells import cell, points_within
from terrajobs.operators.matching import filter_areas
from terrajobs.operators.nearest import nearest_points
from terrajobs.operators.outline import outline_edges

# Pairs of column names that hold latitude and longitude.
COORDINATE_NAMES = (("lat", "lon"), ("lat", "lng"), ("latitudine", "longitudine"), ("latitude", "longitude"))


def find_coord_columns(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> tuple[str, str]:
    """The columns of latitude and longitude: as given, or the first known pair of names in any case. Both must be there and numeric."""
    lower = {c.lower(): c for c in df.columns}
    if latitude is None or longitude is None:
        pair = next(((lower[a], lower[b]) for a, b in COORDINATE_NAMES if a in lower and b in lower), None)
        if pair is None:
            raise ValueError("no columns of coordinates")
        latitude, longitude = pair
    for name in (latitude, longitude):
        if name not in df.columns:
            raise KeyError(f"no column {name!r}")
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise TypeError(f"column {name!r} is not numeric")
    return latitude, longitude


def point_columns(df: DataFrame, latitude: str | None, longitude: str | None, geometry: str | None = None) -> tuple[Column, Column]:
    """(x, y) of each row: longitude and latitude, or those of a geometry column; a polygon counts as its centroid. NaN and infinite ones are null.

    A geometry is taken where it is named, or where no columns of coordinates are named or known and there is a column ``geometry``.
    """
    if geometry is None:
        try:
            lat, lon = find_coord_columns(df, latitude, longitude)
            return finite(F.col(lon).cast("double")), finite(F.col(lat).cast("double"))
        except ValueError:
            if "geometry" not in df.columns:
                raise
            geometry = "geometry"
    if geometry not in df.columns:
        raise KeyError(f"no column {geometry!r}")
    kind = df.schema[geometry].dataType
    if isinstance(kind, T.StructType) and {"x", "y"} <= set(kind.names):
        return finite(F.col(geometry)["x"].cast("double")), finite(F.col(geometry)["y"].cast("double"))
    if kind.simpleString() == POLYGON.simpleString():
        _, x, y = polygon_area_centroid(F.col(geometry))
        return finite(x), finite(y)
    raise TypeError(f"column {geometry!r} is neither points nor polygons")


def to_points(df: DataFrame, latitude: str | None = None, longitude: str | None = None, geometry: str | None = None) -> DataFrame:
    """``df`` with double columns x (longitude) and y (latitude), by coordinates or geometry; rows without either are left out.

    Names that ``df`` has get ``_new``.
    """
    x, y = point_columns(df, latitude, longitude, geometry)
    named = free_names(["x", "y"], df.columns)
    return df.withColumns({named["x"]: x, named["y"]: y}).where(F.col(named["x"]).isNotNull() & F.col(named["y"]).isNotNull())


def locate_points(
    df: DataFrame, areas: DataFrame, attributes: list[str], *, latitude: str | None = None, longitude: str | None = None, geometry: str | None = None,
    polygon: str = "geometry", crs: int = 4326, points_crs: int | None = 4326, side: float | None = None,
) -> DataFrame:
    """``df``, all rows, with the attributes of the area that each point is within; null where there is none.

    Distinct coordinates are located once. A point in several areas has the least attributes. ``crs`` is the
    areas' system and ``points_crs`` the points' (None: detected); ``side`` is the cell in units of ``crs``, by default the
    areas' mean side. Names that ``df`` has get ``_new``.
    """
    x, y = point_columns(df, latitude, longitude, geometry)
    distinct = df.select(x.alias("_lon"), y.alias("_lat")).where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    if points_crs is None:
        points_crs = detect_crs(distinct, "_lon", "_lat", areas, polygon, areas_crs=crs)
    px, py = transform_crs(F.col("_lon"), F.col("_lat"), points_crs, crs)
    found = points_within(distinct.withColumns({"_x": px, "_y": py}), areas, polygon, attributes, side, "_x", "_y")
    found = found.groupBy("_lat", "_lon").agg(F.min(F.struct(*attributes)).alias("_a"))
    named = free_names(attributes, df.columns)
    return attach(df, [x, y], found, ["_lon", "_lat"], {named[a]: F.col("_a")[a] for a in attributes})


def points_in_areas(
    df: DataFrame, areas: DataFrame, key: list[str] | None = None, *, latitude: str | None = None, longitude: str | None = None, geometry: str | None = None, polygon: str = "geometry",
    side: float | None = None,
) -> DataFrame:
    """Rows of ``df`` whose point is within some of the areas. Rows are met by their coordinates, so ``key`` is not needed."""
    x, y = point_columns(df, latitude, longitude, geometry)
    distinct = df.select(x.alias("_lon"), y.alias("_lat")).where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    inside = points_within(distinct, areas, polygon, [], side, "_lon", "_lat").distinct()
    return df.join(inside, (x == F.col("_lon")) & (y == F.col("_lat")), "left_semi")


def detect_crs(df: DataFrame, x: str, y: str, areas: DataFrame, polygon: str = "geometry", sample: int = 100, share: float = 0.8, areas_crs: int = 4326) -> int:
    """The first of 4326, 32632 and 3857 in which 80 % of a sample of up to 100 points lie in the country; 4326 if none.

    The sample is that of least hash: the same in every run; it is drawn once. One row comes to the driver.
    """
    some = df.select(finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    some = materialize(some.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample), "sample")
    tried = None
    for rank, crs in enumerate((4326, 32632, 3857)):
        lon, lat = transform_crs(F.col("x"), F.col("y"), crs, 4326)
        px, py = transform_crs(F.col("_lon"), F.col("_lat"), 4326, areas_crs)
        there = some.withColumns({"_lon": lon, "_lat": lat}).where(F.col("_lon").between(-180, 180) & F.col("_lat").between(-89.9, 89.9))
        there = there.select("x", "y", px.alias("_px"), py.alias("_py"), F.lit(rank).alias("_rank"), F.lit(crs).alias("_crs"))
        tried = there if tried is None else tried.unionByName(there)
    tried = materialize(tried, "tried")
    inside = points_within(tried, areas, polygon, [], None, "_px", "_py").distinct().groupBy("_rank", "_crs").count()
    total = some.count()
    first = inside.where(F.col("count") >= share * total).orderBy("_rank").limit(1).collect()
    return first[0]["_crs"] if first else 4326


def national_outline(areas: DataFrame, polygon: str = "geometry", decimals: int = 9) -> DataFrame:
    """The outer edges (x1, y1, x2, y2) of all areas together, from their lesser end: borders that areas share, whole or in part, cancel."""
    edges = outline_edges(areas, polygon, [], decimals)
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    return edges.select(*(F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))


#: Grid points of a finest cell on the average, and finest cells in a radius at most.
POINTS_A_CELL, CELLS_A_RADIUS = 16, 256


def _disc_rows(x: Column, y: Column, r: float, side: float) -> Column:
    """The rows of cells that a disc around (x, y) reaches: cy; first and last cell that it touches; first and, less one, last that lie inside."""
    slack = 1e-9 * r + 1e-12

    def row(cy: Column) -> Column:
        low, high = cy * side, (cy + 1) * side
        far, near = F.greatest(F.abs(low - y), F.abs(high - y)), F.greatest(F.lit(0.0), low - y, y - high)
        reach, inner = F.sqrt(F.greatest(F.lit(0.0), r * r - near * near)) + slack, F.when(far < r, F.sqrt(r * r - far * far) - slack)
        start, end = F.ceil((x - inner) / side), F.floor((x + inner) / side)
        start, end = (F.when(start < end, v).cast("long") for v in (start, end))
        return F.struct(cy.alias("cy"), cell(x - reach, side).alias("first"), cell(x + reach, side).alias("last"), start.alias("start"), end.alias("end"))

    return F.transform(F.sequence(cell(y - r - slack, side), cell(y + r + slack, side)), row)


def _whole_pieces(row: Column, levels: int) -> Column:
    """The run of cells that lie inside, as cells of doubling width: (level, place, cy). At most two of a level."""
    out = []
    for k in range(levels):
        start, end = F.ceil(row["start"] / 2**k).cast("long"), F.floor(row["end"] / 2**k).cast("long")
        piece = lambda at, k=k: F.struct(F.lit(k).alias("k"), at.alias("c"), row["cy"].alias("cy"))
        out += [F.when((start < end) & (start % 2 != 0), piece(start)), F.when((start < end) & (end % 2 != 0), piece(end - 1))]
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def _border_cells(row: Column) -> Column:
    """Cells of a row that the disc touches but that may not lie inside: (c, cy)."""
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    beside = F.concat(span(row["first"], row["start"] - 1), span(row["end"], row["last"]))
    return F.transform(F.when(row["start"].isNull(), F.sequence(row["first"], row["last"])).otherwise(beside), lambda c: F.struct(c.alias("c"), row["cy"].alias("cy")))


def disc_pieces(asked: DataFrame, r: float, side: float, levels: int) -> tuple[DataFrame, DataFrame]:
    """``x, y`` with the whole pieces (k, c, cy) and with the border cells (c, cy) of the disc around each."""
    rows = _disc_rows(F.col("x"), F.col("y"), r, side)
    each = lambda f: asked.select("x", "y", F.explode(F.flatten(F.transform(rows, f))).alias("p")).select("x", "y", "p.*")
    return each(lambda row: _whole_pieces(row, levels)), each(_border_cells)


def population_nearby(
    df: DataFrame, grid: DataFrame, radius: float, key: str | None = None, *, latitude: str | None = None, longitude: str | None = None, geometry: str | None = None
) -> DataFrame:
    """``df``, all rows, with ``n_residents``: population of the grid points (Lon, Lat, Population) nearer than ``radius`` metres.

    The radius is turned into degrees once. The grid is summed once into cells of doubling width, of which the finest hold some POINTS_A_CELL
    points. A disc is, row by row of these, a few whole cells and on its border finest cells whose points are looked at one by one, so what
    meets a point grows with the radius and not with the disc. A radius under 50 raises. Each distinct point is asked for once, whatever rows
    have it, so ``key`` is not needed; points without coordinates have no residents, and grid points without coordinates or population do not count. Where ``df``
    has n_residents, the new column is n_residents_new.
    """
    if not isinstance(radius, (int, float)) or isinstance(radius, bool):
        raise TypeError("radius is a number of metres")
    if radius < 50:
        raise ValueError("radius is 50 metres at least")
    r = radius_in_degrees(radius)
    x, y = point_columns(df, latitude, longitude, geometry)
    asked = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    told = (finite(F.col(c).cast("double")).alias(n) for c, n in (("Lon", "gx"), ("Lat", "gy"), ("Population", "p")))
    points = grid.select(*told).where("gx IS NOT NULL AND gy IS NOT NULL AND p IS NOT NULL")
    n, *box = points.agg(F.count("*"), F.min("gx"), F.min("gy"), F.max("gx"), F.max("gy")).first()
    wide, high = (box[2] - box[0], box[3] - box[1]) if n else (0.0, 0.0)
    side = min(r, max(r / CELLS_A_RADIUS, (wide * high * POINTS_A_CELL / n) ** 0.5 if wide and high else (wide + high) * POINTS_A_CELL / max(n, 1)))
    levels = int(log2(2 * r / side)) + 1
    filed = points.withColumns({"c": cell("gx", side), "cy": cell("gy", side)})
    fine = filed.groupBy("c", "cy").agg(F.sum("p").alias("p"))
    doubled = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(F.col("c") / 2**k).cast("long").alias("c")) for k in range(levels))))
    summed = fine.select("cy", "p", doubled.alias("at")).groupBy("at.k", "at.c", "cy").agg(F.sum("p").alias("p"))
    whole, border = disc_pieces(asked, r, side, levels)
    near = border.join(filed, ["c", "cy"]).where((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2 < r * r)
    parts = whole.join(summed, ["k", "c", "cy"]).select("x", "y", "p").unionByName(near.select("x", "y", "p"))
    sums = parts.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.sum("p").cast("double").alias("_sum"))
    out = free_names(["n_residents"], df.columns)["n_residents"]
    return attach(df, [x, y], sums, ["_x", "_y"], {out: F.col("_sum")}, {out: F.lit(0.0)})


#: Pairs of points that two cells may be compared by directly; larger pairs of cells are cut into smaller ones first.
FEW_PAIRS = 4096


def _boxed(points: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Cells: number of points, their own box and one of them."""
    box = [f(a).alias(f"{k}_{a}") for a in axes for k, f in (("low", F.min), ("high", F.max))]
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("x", "y")).alias("one"), *box)


def _gaps(axes: list[str], a: str, b: str) -> tuple[Column, Column]:
    """Squared distances that no pair of points of two boxes is below or above."""
    near, far = F.lit(0.0), F.lit(0.0)
    for k in axes:
        apart = F.greatest(F.lit(0.0), F.col(f"{b}.low_{k}") - F.col(f"{a}.high_{k}"), F.col(f"{a}.low_{k}") - F.col(f"{b}.high_{k}"))
        across = F.greatest(F.col(f"{b}.high_{k}") - F.col(f"{a}.low_{k}"), F.col(f"{a}.high_{k}") - F.col(f"{b}.low_{k}"))
        near, far = near + apart * apart, far + across * across
    return near, far


def cell_links(points: DataFrame, axes: list[str], reach: float, close, side: float, steps: list[tuple], few: int = FEW_PAIRS, most_levels: int = 48) -> DataFrame:
    """``src, dst``: roots of cells ``steps`` apart that hold a pair of close points.

    ``points`` (x, y, axes, root, cell) are distinct; ``cell`` is the array of their places on a grid of ``side``. A pair of cells is
    decided by the boxes of their points or by one point of each; if not and they hold few points, by these; else both are cut into
    cells of half the side, and the pairs of these are asked. So no task holds a cell, and points that are far from the other cell
    meet none of it.
    """
    limit = reach * reach
    place = F.col("cell")
    cells = materialize(_boxed(points, ["root", "cell"], axes), "cells")
    moved = F.explode(F.array(*(F.array(*(place[i] + F.lit(s).cast("long") for i, s in enumerate(step))) for step in steps)))
    a = cells.select(F.struct(*cells.columns).alias("a"), moved.alias("_there"))
    pairs = a.join(cells.select(F.struct(*cells.columns).alias("b")), F.col("_there") == F.col("b.cell")).drop("_there")
    links = None
    for level in range(most_levels):
        near, far = _gaps(axes, "a", "b")
        meet = close(F.col("a.one.x"), F.col("a.one.y"), F.col("b.one.x"), F.col("b.one.y"))
        sure = (far < limit * (1 - 1e-9)) | meet
        # Each pair of roots is settled by the first pair of cells that is.
        asked = materialize(pairs.where(near < limit * (1 + 1e-9)).select("a", "b", sure.alias("sure"), (F.col("a.n") * F.col("b.n") <= few).alias("small")), "pairs")
        settled = asked.where("sure").select(F.col("a.root").alias("src"), F.col("b.root").alias("dst")).distinct()
        open_ = asked.where("NOT sure").join(settled.withColumnsRenamed({"src": "_src", "dst": "_dst"}), (F.col("a.root") == F.col("_src")) & (F.col("b.root") == F.col("_dst")), "left_anti")
        cut = points.withColumn("cell", F.array(*(cell(k, side / 2**level) for k in axes)))
        of = lambda s: cut.select(F.col("root").alias(f"_root_{s}"), F.col("cell").alias(f"_cell_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
        at = lambda s: (F.col(f"{s}.root") == F.col(f"_root_{s}")) & (F.col(f"{s}.cell") == F.col(f"_cell_{s}"))
        direct = open_.where("small").join(of("a"), at("a")).join(of("b"), at("b")).where(close(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")))
        found = materialize(settled.unionByName(direct.select(F.col("_root_a").alias("src"), F.col("_root_b").alias("dst"))).distinct(), "links")
        links = found if links is None else links.unionByName(found)
        large = open_.where("NOT small").join(found.withColumnsRenamed({"src": "_src", "dst": "_dst"}), (F.col("a.root") == F.col("_src")) & (F.col("b.root") == F.col("_dst")), "left_anti")
        large = materialize(large.select("a", "b"), "large")
        if large.isEmpty():
            return links
        # Halves know the cell that they are of: a grid of half the side halves every place.
        finer = points.withColumn("cell", F.array(*(cell(k, side / 2 ** (level + 1)) for k in axes)))
        halves = _boxed(finer, ["root", "cell"], axes)
        halves = materialize(halves.select(F.struct(*halves.columns).alias("h"), F.transform("cell", lambda c: F.floor(c / 2).cast("long")).alias("_of"), "root"), "halves")
        for s in ("a", "b"):
            mine = halves.select(F.col("h").alias(f"_h{s}"), F.col("_of").alias(f"_of{s}"), F.col("root").alias(f"_r{s}"))
            large = large.join(mine, (F.col(f"{s}.root") == F.col(f"_r{s}")) & (F.col(f"{s}.cell") == F.col(f"_of{s}"))).drop(f"_r{s}", f"_of{s}")
        pairs = large.select(F.col("_ha").alias("a"), F.col("_hb").alias("b"))
    raise RuntimeError(f"cells are not told apart in {most_levels} levels")


def cluster_by_distance(
    df: DataFrame, metres: float, key: str, *, latitude: str | None = None, longitude: str | None = None, geometry: str | None = None, metric: str = "degrees", few: int = FEW_PAIRS
) -> DataFrame:
    """``df``, all rows, with ``aggregation_code``: the smallest key of the points that chains of steps under ``metres`` reach.

    Points of a cell small enough are all linked, so the graph's nodes are cells, not points; of two cells it is asked whether any two of
    their points are close. In metric ``degrees`` the grid is over longitude and latitude; in ``haversine`` it is in space, over
    the sphere's own coordinates, where no meridian and no pole is special. Rows are met by their coordinates, so rows with one key or
    one place do not multiply. Null coordinates have a null code. Where ``df`` has that column, the new one is aggregation_code_new.
    """
    if metres <= 0:
        raise ValueError("the distance is above 0")
    if metric not in ("degrees", "haversine"):
        raise ValueError("the metric is degrees or haversine")
    x, y = point_columns(df, latitude, longitude, geometry)
    pts = df.select(x.alias("x"), y.alias("y"), F.col(key).alias("id")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min("id").alias("id"))
    if metric == "degrees":
        reach, axes = radius_in_degrees(metres), {"u": F.col("x"), "v": F.col("y")}
        close = lambda x1, y1, x2, y2: (x1 - x2) ** 2 + (y1 - y2) ** 2 < F.lit(reach * reach)
    else:
        reach = 2 * MEAN_RADIUS * sin(min(pi / 2, metres / (2 * MEAN_RADIUS)))
        level, turn = F.cos(F.radians("y")) * MEAN_RADIUS, F.radians("x")
        axes = {"u": level * F.cos(turn), "v": level * F.sin(turn), "w": F.sin(F.radians("y")) * MEAN_RADIUS}
        close = lambda x1, y1, x2, y2: haversine_m(x1, y1, x2, y2) < F.lit(float(metres))
    names = list(axes)
    side = 0.99 * reach / len(names) ** 0.5
    pts = pts.withColumns(axes).withColumn("cell", F.array(*(cell(k, side) for k in names)))
    roots = pts.groupBy(F.col("cell").alias("_cell")).agg(F.min("id").alias("root"))
    pts = materialize(pts.join(roots, F.col("cell") == F.col("_cell")).drop("_cell"), "points")
    steps = [s for s in product(range(-2, 3), repeat=len(names)) if s > (0,) * len(names)]
    joined = connected_components(cell_links(pts.drop("id"), names, reach, close, side, steps, few))
    codes = pts.select("x", "y", "root").join(joined, F.col("root") == F.col("node"), "left").select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.coalesce("component", "root").alias("_code"))
    out = free_names(["aggregation_code"], df.columns)["aggregation_code"]
    return attach(df, [x, y], codes, ["_x", "_y"], {out: F.col("_code")})


def cluster_summary(clustered: DataFrame, code: str = "aggregation_code") -> DataFrame:
    """One row: number of groups and size of the largest."""
    return clustered.where(F.col(code).isNotNull()).groupBy(code).count().agg(F.count("*").alias("n_groups"), F.max("count").alias("largest"))


def line_segments(lines: DataFrame, geometry: str = "geometry", keep: list[str] = ()) -> DataFrame:
    """A row per segment of each line: keep, x1, y1, x2, y2."""
    line = F.col(geometry)
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return lines.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.*")


def near_segments(points: DataFrame, key: list[str], segments: DataFrame, radius: float, x: str, y: str, keep: list[str] = (), side: float | None = None) -> DataFrame:
    """``key, keep`` of points and segments nearer than ``radius`` (or touching it, at radius 0)."""
    side = side or max(radius, 1e-3)
    box = {"ax": F.least("x1", "x2") - radius, "bx": F.greatest("x1", "x2") + radius, "ay": F.least("y1", "y2") - radius, "by": F.greatest("y1", "y2") + radius}
    filed = segments.withColumns(box).withColumn("cx", F.explode(F.sequence(cell("ax", side), cell("bx", side)))).withColumn("cy", F.explode(F.sequence(cell("ay", side), cell("by", side))))
    met = points.withColumns({"cx": cell(x, side), "cy": cell(y, side)}).join(filed, ["cx", "cy"])
    gap = segment_distance2(F.col(x), F.col(y), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return met.where(gap <= radius * radius if radius == 0 else gap < radius * radius).select(*key, *keep).distinct()


def points_on_highway(df: DataFrame, highways: DataFrame, latitude: str, longitude: str, radius: float = 50, side: float = 0.05) -> DataFrame:
    """``df`` with ``in_highway``: whether a line of class Autostrada passes nearer than ``radius`` metres. One row per row of ``df``."""
    lines = line_segments(highways.where("classificazione = 'Autostrada'"))
    points = df.select(finite(F.col(latitude).cast("double")).alias("_lat"), finite(F.col(longitude).cast("double")).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    near = near_segments(points, ["_lat", "_lon"], lines, radius_in_degrees(radius), "_lon", "_lat", side=side)
    out = free_names(["in_highway"], df.columns)["in_highway"]
    return attach(df, [F.col(latitude).cast("double"), F.col(longitude).cast("double")], near, ["_lat", "_lon"], {out: F.lit(True)}, {out: F.lit(False)})


def nearest_exits(df: DataFrame, exits: DataFrame, key: str, latitude: str, longitude: str, n: int = 1, side: float | None = None) -> DataFrame:
    """``key, exits``: an array of the ``n`` nearest exits (id, x, y), nearest first, by distance in degrees."""
    points = df.select(key, F.col(longitude).alias("x"), F.col(latitude).alias("y"))
    near = nearest_points(points, key, exits.select(F.col("id").alias("_exit"), F.col("x").alias("tx"), F.col("y").alias("ty")), "_exit", n, side)
    listed = F.array_sort(F.collect_list(F.struct("rank", "_exit", "tx", "ty")))
    return near.groupBy(key).agg(F.transform(listed, lambda e: F.struct(e["_exit"].alias("id"), e["tx"].alias("x"), e["ty"].alias("y"))).alias("exits"))


def distance_to_highway(df: DataFrame, exits: DataFrame, key: str | None, latitude: str, longitude: str, side: float | None = None, ellipsoid: bool = True) -> DataFrame:
    """``df``, all rows, with ``distance_m``: metres to the nearest exit of an Autostrada; null without coordinates or exits.

    Each distinct point is asked for once, whatever rows have it, so ``key`` is not needed.
    """
    metres = geodesic_distance_m if ellipsoid else haversine_m
    spots = df.select(finite(F.col(latitude).cast("double")).alias("_lat"), finite(F.col(longitude).cast("double")).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    spots = spots.withColumn("_id", F.struct("_lat", "_lon"))
    found = nearest_exits(spots, exits.where("classificazione = 'Autostrada'"), "_id", "_lat", "_lon", 1, side)
    told = found.select("_id.*", metres(F.col("_id._lon"), F.col("_id._lat"), F.col("exits")[0]["x"], F.col("exits")[0]["y"]).alias("_metres"))
    out = free_names(["distance_m"], df.columns)["distance_m"]
    return attach(df, [F.col(latitude).cast("double"), F.col(longitude).cast("double")], told, ["_lat", "_lon"], {out: F.col("_metres")})


def area_bounds(areas: DataFrame, polygon: str = "geometry", source: int = 4326, target: int = 3857) -> DataFrame:
    """One row: min_x, min_y, max_x, max_y of the areas' vertices in a target system; null without areas. NaN and infinite vertices do not count."""
    v = areas.select(F.explode(F.flatten(F.flatten(polygon))).alias("v"))
    x, y = (finite(c) for c in transform_crs(F.col("v.x"), F.col("v.y"), source, target))
    return v.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def chosen_bounds(areas: DataFrame, *, comune=None, provincia=None, regione=None, polygon: str = "geometry", source: int = 4326, target: int = 3857) -> DataFrame:
    """One row: the bounds of the comuni asked for, else of the provinces, else of the regions; without any, of all areas: Italy.

    One or a list, as code, sigla or name in any spelling, as in ``filter_areas``; an empty list asks for none and finds nothing. Raises where nothing is found.
    """
    level = next(({k: v} for k, v in (("comune", comune), ("provincia", provincia), ("regione", regione)) if v is not None), {})
    found = filter_areas(areas, **level)
    if found.where(F.col(polygon).isNotNull()).isEmpty():
        raise ValueError(f"no areas {level}")
    return area_bounds(found, polygon, source, target)


def filter_bounds(df: DataFrame, bounds: tuple[float, float, float, float], longitude: str, latitude: str) -> DataFrame:
    """Rows inside (min_x, min_y, max_x, max_y), edges included."""
    return df.where(F.col(longitude).between(bounds[0], bounds[2]) & F.col(latitude).between(bounds[1], bounds[3]))
