"""Areas filed under the cells of a grid, and the points within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrajobs.functions.geo import inside_edges, polygon_bounds, polygon_edges


def cell(v: Column | str, side: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(side)).cast("long")


def mean_side(areas: DataFrame, polygon: str) -> float:
    """The mean of the areas' wider sides, in their own units: a cell as large as a usual area. One row to the driver."""
    box = polygon_bounds(F.col(polygon))
    side = areas.select(F.avg(F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]))).first()[0]
    return side or 1.0


def area_cells(areas: DataFrame, polygon: str, side: float, keep: list[str]) -> DataFrame:
    """A row per area and cell that it reaches, with the columns ``keep``, ``inner`` and ``edges``.

    A cell that no edge comes near lies wholly inside, and is ``inner`` and has no edges, or wholly outside, and has no row. Cells on the border have
    those edges that a ray from the cell to the right may cross; an edge above, below or left of a cell is none of these.
    """
    box = polygon_bounds(F.col(polygon))
    rows = areas.where(F.col(polygon).isNotNull()).select(*keep, polygon_edges(F.col(polygon)).alias("edges"), *(v.alias(k) for k, v in box.items()))
    rows = rows.withColumn("cy", F.explode(F.sequence(cell("min_y", side), cell("max_y", side))))
    low, high = F.col("cy") * side, (F.col("cy") + 1) * side
    slack = side * 1e-9
    beside = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low - slack) & (F.least(e["y1"], e["y2"]) <= high + slack))
    rows = rows.withColumn("edges", beside).where(F.size("edges") > 0).withColumn("cx", F.explode(F.sequence(cell("min_x", side), cell("max_x", side))))
    right = F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("cx") * side - slack)
    rows = rows.withColumn("edges", right).where(F.size("edges") > 0)
    near = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= (F.col("cx") + 1) * side + slack)
    within = inside_edges((F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, F.col("edges"))
    rows = rows.withColumn("border", near).where(F.col("border") | within).withColumn("inner", ~F.col("border"))
    return rows.withColumn("edges", F.when(F.col("border"), F.col("edges"))).drop("border", "min_x", "min_y", "max_x", "max_y")


def points_within(points: DataFrame, areas: DataFrame, polygon: str, keep: list[str], side: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Every point with every area that it is strictly within: columns of ``points`` and ``keep``.

    ``side`` is that of the cells, by default the areas' mean.
    """
    side = mean_side(areas, polygon) if side is None else side
    of = {k: f"_keep{i}" for i, k in enumerate(keep)}
    cells = area_cells(areas.select(F.col(polygon).alias("_polygon"), *(F.col(k).alias(n) for k, n in of.items())), "_polygon", side, list(of.values()))
    cells = cells.withColumnsRenamed({"cx": "_cx", "cy": "_cy", "edges": "_edges", "inner": "_inner"})
    met = points.withColumns({"_cell_x": cell(x, side), "_cell_y": cell(y, side)}).join(cells, (F.col("_cell_x") == F.col("_cx")) & (F.col("_cell_y") == F.col("_cy")))
    return met.where(F.col("_inner") | inside_edges(F.col(x), F.col(y), F.col("_edges"))).select(*points.columns, *(F.col(n).alias(k) for k, n in of.items()))
