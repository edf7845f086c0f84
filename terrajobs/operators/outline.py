"""Areas put together: their outline as edges, and as polygons.

Every ring is turned so that its area lies on the left. Edges are cut wherever a vertex of some area lies on them, so that two areas
that meet in a T have the pieces of their border in common, and pieces that are gone along in both ways cancel. What remains is chained into
rings by doubling pointers: each piece knows the one 1, 2, 4, ... pieces ahead, so a ring of n pieces takes about 2 log n joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrajobs.functions.geo import POLYGON, ring_edges
from terrajobs.functions.storage import drop, materialize
from terrajobs.operators.cells import cell, points_within


def _twice_area(ring: Column) -> Column:
    """The shoelace sum, above 0 if the ring turns to the left; taken from the first vertex, so that large coordinates lose no digits."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy))


def directed_edges(areas: DataFrame, polygon: str, by: list[str], decimals: int) -> DataFrame:
    """``by, x1, y1, x2, y2``: the sides of all rings with their area on the left; coordinates rounded, sides without length left out."""

    def turned(ring: Column, i: Column) -> Column:
        near = F.transform(ring, lambda v: F.struct(F.round(v["x"], decimals).alias("x"), F.round(v["y"], decimals).alias("y")))
        # The first ring of a part is its outside, the others are holes.
        return F.transform(F.array(near), lambda r: F.when((_twice_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))[0]

    edges = F.flatten(F.transform(F.col(polygon), lambda part: F.flatten(F.transform(F.transform(part, turned), ring_edges))))
    return areas.where(F.col(polygon).isNotNull()).select(*by, F.explode(edges).alias("e")).select(*by, "e.*").where("x1 <> x2 OR y1 <> y2")


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def cut_at_vertices(edges: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """The edges in pieces: cut where an end of another edge of the same ``by`` lies on them, nearer than ``tolerance``.

    Edges are filed under the cells along them, ends under one cell. Cells are as wide as edges are on the average.
    """
    known = materialize(edges.withColumn("_id", F.monotonically_increasing_id()), "edges")
    side = known.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 1.0
    rows = F.sequence(cell(F.least("y1", "y2") - tolerance, side), cell(F.greatest("y1", "y2") + tolerance, side))
    filed = known.withColumn("_cy", F.explode(rows))
    # The part of an edge that lies in a row of cells.
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None).cast("double")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("y1")) / (F.col("y2") - F.col("y1")))))
    a, b = at(F.col("_cy") * side - tolerance), at((F.col("_cy") + 1) * side + tolerance)
    low, high = F.coalesce(F.least(a, b), F.least("x1", "x2")), F.coalesce(F.greatest(a, b), F.greatest("x1", "x2"))
    filed = filed.withColumn("_cx", F.explode(F.sequence(cell(low - 2 * tolerance, side), cell(high + 2 * tolerance, side))))
    ends = known.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by)), F.col("x1").alias("px"), F.col("y1").alias("py")).distinct()
    ends = ends.withColumns({"_px": cell("px", side), "_py": cell("py", side)})
    met = filed.join(ends, _same(filed, ends, [("_cx", "_px"), ("_cy", "_py"), *((k, f"_by{i}") for i, k in enumerate(by))]))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    across = (F.col("px") - F.col("x1")) * dy - (F.col("py") - F.col("y1")) * dx
    other = ((F.col("px") != F.col("x1")) | (F.col("py") != F.col("y1"))) & ((F.col("px") != F.col("x2")) | (F.col("py") != F.col("y2")))
    on = met.where((t > 0) & (t < 1) & (across * across <= tolerance * tolerance * (dx * dx + dy * dy)) & other)
    cuts = on.groupBy(F.col("_id").alias("_at")).agg(F.sort_array(F.collect_list(F.struct(t.alias("t"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("_cuts"))
    joined = known.join(cuts, F.col("_id") == F.col("_at"), "left")
    vertex = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    between = F.coalesce(F.transform("_cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    line = F.concat(vertex("x1", "y1"), between, vertex("x2", "y2"))
    pieces = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return joined.select(*by, F.explode(pieces).alias("e")).select(*by, "e.*").where("x1 <> x2 OR y1 <> y2")


def outline_edges(areas: DataFrame, polygon: str = "geometry", by: list[str] = (), decimals: int = 9) -> DataFrame:
    """``by, x1, y1, x2, y2``: the outer edges of all areas (of one ``by``) together, the inside on the left.

    Areas may meet along parts of their sides, and may be there twice. Areas that overlap in part keep the borders that lie inside others.
    """
    by = list(by)
    pieces = cut_at_vertices(directed_edges(areas, polygon, by, decimals), by, 2 * 10.0**-decimals)
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ways = pieces.select(*by, *(F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))), F.when(ahead, 1).otherwise(-1).alias("way"))
    # A piece that has some area on both of its sides is no outline, however many there are.
    left = ways.groupBy(*by, "x1", "y1", "x2", "y2").agg(F.min("way").alias("way"), F.max("way").alias("_other")).where("way = _other")
    return left.select(*by, *(F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))


def _doubled(state: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
    """``id, ptr`` and values a step on: each row with that at its pointer (columns ``there_*``), until nothing changes. One row a round comes to the driver."""
    state = materialize(state, name)
    while True:
        there = state.select(*(F.col(c).alias(f"there_{c}") for c in state.columns))
        moved = state.join(there, F.col("ptr") == F.col("there_id"))
        new = materialize(moved.select("id", F.col("there_ptr").alias("ptr"), *(v.alias(k) for k, v in values.items()), *(F.col(k).alias(f"was_{k}") for k in values)), name)
        changed = new.where(" OR ".join(f"{k} <> was_{k}" for k in values)).isEmpty()
        drop(state)
        state = new.select(*("id", "ptr"), *values)
        if changed:
            return state
        state._terrajobs_path = new._terrajobs_path


def rings(edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, ring``: closed rings of vertices, chained from directed edges, beginning at any of them.

    Where rings touch in a vertex, the edge most to the left goes on, so that they stay apart. Edges that lead nowhere are left out.
    """
    known = materialize(edges.withColumn("id", F.monotonically_increasing_id()), "directed")
    ahead = known.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by)), F.col("id").alias("next"), F.col("x1").alias("_x"), F.col("y1").alias("_y"), F.col("x2").alias("_x2"), F.col("y2").alias("_y2"))
    met = known.join(ahead, _same(known, ahead, [("x2", "_x"), ("y2", "_y"), *((k, f"_by{i}") for i, k in enumerate(by))]))
    ux, uy, vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("_x2") - F.col("_x"), F.col("_y2") - F.col("_y")
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    follow = materialize(met.groupBy("id").agg(F.max_by("next", turn).alias("next")), "follow")
    least = _doubled(follow.select("id", F.col("next").alias("ptr"), F.least("id", "next").alias("least")), {"least": F.least("least", "there_least")}, "least")
    led = follow.join(least.select(F.col("id").alias("_id"), "least"), F.col("id") == F.col("_id")).drop("_id")
    first = F.col("id") == F.col("least")
    start = led.select("id", F.when(first, F.col("id")).otherwise(F.col("next")).alias("ptr"), F.when(first, 0).otherwise(1).cast("long").alias("togo"))
    togo = _doubled(start, {"togo": F.col("togo") + F.col("there_togo")}, "togo")
    # Only what has come to its ring's first edge is on a ring.
    placed = known.join(togo.select(F.col("id").alias("_id"), F.col("ptr").alias("_first"), "togo"), F.col("id") == F.col("_id"))
    placed = placed.join(least.where("id = least").select(F.col("id").alias("_leader")), F.col("_first") == F.col("_leader"))
    order = F.when(F.col("togo") == 0, F.lit(-(1 << 62))).otherwise(-F.col("togo"))
    listed = placed.groupBy(*by, "_first").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("v"))))["v"].alias("v"))
    return listed.select(*by, F.concat("v", F.slice("v", 1, 1)).alias("ring"))


def dissolve(areas: DataFrame, polygon: str = "geometry", by: list[str] = (), decimals: int = 9) -> DataFrame:
    """``by, geometry``: one polygon of all areas of each ``by`` together, with its islands as parts and its holes.

    A hole belongs to the smallest ring that it lies in. Without areas there are no rows.
    """
    by = list(by)
    told = rings(outline_edges(areas, polygon, by, decimals), by).withColumn("_area", _twice_area(F.col("ring")))
    told = materialize(told.withColumn("_ring", F.monotonically_increasing_id()), "rings")
    outer = told.where("_area > 0")
    a, b = F.col("ring")[0], F.col("ring")[1]
    holes = told.where("_area < 0").select(*by, F.col("ring").alias("_hole"), ((a["x"] + b["x"]) / 2).alias("_hx"), ((a["y"] + b["y"]) / 2).alias("_hy"), F.col("_ring").alias("_hole_id"))
    around = outer.select(F.array(F.array("ring")).cast(POLYGON).alias("_outer"), F.col("_ring").alias("_in"), F.col("_area").alias("_size"), *(F.col(k).alias(f"_by{i}") for i, k in enumerate(by)))
    met = points_within(holes, around, "_outer", ["_in", "_size", *(f"_by{i}" for i in range(len(by)))], None, "_hx", "_hy")
    for i, k in enumerate(by):
        met = met.where(F.col(k).eqNullSafe(F.col(f"_by{i}")))
    of = met.groupBy("_hole_id").agg(F.min_by("_in", "_size").alias("_in"), F.first("_hole").alias("_hole")).groupBy("_in").agg(F.sort_array(F.collect_list("_hole")).alias("_holes"))
    parts = outer.join(of, F.col("_ring") == F.col("_in"), "left").withColumn("_part", F.concat(F.array("ring"), F.coalesce("_holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    return parts.groupBy(*by).agg(F.sort_array(F.collect_list("_part")).cast(POLYGON).alias("geometry")) if by else parts.groupBy(F.lit(0).alias("_all")).agg(F.sort_array(F.collect_list("_part")).cast(POLYGON).alias("geometry")).drop("_all")
