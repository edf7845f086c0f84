"""Nearest neighbours by cells that follow the density of the targets.

The targets' box is halved until each cell holds few of them, first into cells of large and then of smaller and smaller numbers, so that
the cells of one table are parts of those of the table before. Each point goes down these tables: of the cells that are still open it keeps
those that may hold one of its nearest, by the boxes and the numbers of their targets. Only the targets of the last table's cells are met.

Points go down in blocks: neighbours on a Z-curve, up to some hundred in one cell of a grid, so that the tables are met by blocks and the targets of the
last cells by a block at once, in arrays of distances.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrajobs.functions.geo import finite
from terrajobs.functions.storage import materialize

#: Targets of a cell at most, where the finest cells tell them apart; a table's cells hold so many times more than those of the next; the
#: first table's hold this share of all, so that it has some hundred rows, which come to the driver.
FEW, GROWTH, TOP = 64, 16, 32
#: Halvings down to the finest cells, and how many are taken at once.
DEPTH, STEP = 24, 2
#: Points of a block at most, and targets that a task's block meets at once, about.
BLOCK, CHUNK = 256, 20_000
_BOXES = "array<struct<bin: bigint, n: bigint, x0: double, y0: double, x1: double, y1: double>>"


def _cell_id(level: Column, ix: Column, iy: Column) -> Column:
    """One number for a level and the place on it of a finest cell."""
    # pyspark's shiftright takes literal widths alone.
    wide = F.pow(F.lit(2.0), (DEPTH - level).cast("double"))
    at = lambda i: F.floor(i / wide).cast("long")
    return (level.cast("long") * (1 << DEPTH) + at(ix)) * (1 << DEPTH) + at(iy)


def placed(spots: DataFrame, box, total: int, few: int = FEW, side: float | None = None) -> tuple[DataFrame, int]:
    """``spots`` with ``_leaf0, _leaf1, ...``: the cell of each table that a target is in, written; and the number of tables.

    Numbers of all cells of all levels are summed up from the finest ones, once. A cell of ``side`` or less is not halved.
    """
    width = max(box[2] - box[0], box[3] - box[1], 1e-12)
    at = lambda v, low: F.least(F.floor((F.col(v) - low) / width * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    filed = spots.withColumns({"_ix": at("tx", box[0]), "_iy": at("ty", box[1])})
    fine = materialize(filed.groupBy("_ix", "_iy").agg(F.count("*").alias("n")), "finest")
    levels = F.explode(F.array(*(F.lit(k) for k in range(0, DEPTH + 1, STEP))))
    of = fine.withColumn("level", levels).withColumn("cell", _cell_id(F.col("level"), F.col("_ix"), F.col("_iy")))
    sums = of.groupBy("cell").agg(F.sum("n").alias("inside"))
    tables = [few]
    while tables[0] * TOP < total:
        tables.insert(0, tables[0] * GROWTH)
    small = F.lit(False) if side is None else F.lit(width) / F.pow(F.lit(2.0), F.col("level").cast("double")) <= side
    leaf = lambda most: _cell_id(F.coalesce(F.min(F.when((F.col("inside") <= most) | small, F.col("level"))), F.lit(DEPTH)), F.col("_ix"), F.col("_iy"))
    tree = of.join(sums, "cell").groupBy("_ix", "_iy").agg(*(leaf(most).alias(f"_leaf{i}") for i, most in enumerate(tables)))
    return materialize(filed.join(tree, ["_ix", "_iy"]).drop("_ix", "_iy"), "placed"), len(tables)


def _boxes(spots: DataFrame, i: int) -> DataFrame:
    """The cells of a table: number of targets and their own box, and the cell of the table before."""
    above = [F.min(f"_leaf{i - 1}").alias("above")] if i else []
    return spots.groupBy(F.col(f"_leaf{i}").alias("bin")).agg(F.count("*").alias("n"), F.min("tx").alias("x0"), F.min("ty").alias("y0"), F.max("tx").alias("x1"), F.max("ty").alias("y1"), *above)


def _bounds(b, low=("x", "y"), high=("x", "y")) -> Column:
    """(most, least, n, bin): squared distances of (x, y), or of any point of a box from ``low`` to ``high``, that no target of a box is above or below."""
    (x, y), (u, v) = map(F.col, low), map(F.col, high)
    dx, dy = F.greatest(b["x0"] - u, x - b["x1"], F.lit(0.0)), F.greatest(b["y0"] - v, y - b["y1"], F.lit(0.0))
    ex, ey = F.greatest(F.abs(u - b["x0"]), F.abs(x - b["x1"])), F.greatest(F.abs(v - b["y0"]), F.abs(y - b["y1"]))
    return F.struct((ex * ex + ey * ey).alias("most"), (dx * dx + dy * dy).alias("least"), b["n"].alias("n"), b["bin"].alias("bin"))


def _open(bounds: Column, n: int, most: float | None) -> Column:
    """Of cells in order of the farthest that they reach: those that may hold one of the ``n`` nearest.

    The first cell at which n targets are counted bounds the n-th nearest.
    """
    limit = float("inf") if most is None else most * most
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(limit).alias("most"))
    count = lambda acc, b: F.when(acc["n"] >= n, acc).otherwise(F.struct((acc["n"] + b["n"]).alias("n"), F.when(acc["n"] + b["n"] >= n, F.least(acc["most"], b["most"])).otherwise(acc["most"]).alias("most")))
    reach = F.transform(F.array(F.aggregate(bounds, start, count)["most"]), lambda m: F.filter(bounds, lambda b: b["least"] <= m * (1 + 1e-9)))
    return F.transform(reach[0], lambda b: b["bin"])


def _last_cells(points: DataFrame, key: str, spots: DataFrame, tables: int, n: int, most: float | None, low=("x", "y"), high=("x", "y")) -> DataFrame:
    """``key``, the place columns and ``_b``: the cells of the last table as ``_bounds`` of those open in the table before."""
    place = list(dict.fromkeys([*low, *high]))
    top = [r.asDict() for r in _boxes(spots, 0).orderBy("bin").collect()]
    bins = F.from_json(F.lit(json.dumps(top)), _BOXES)
    told = points.withColumn("_b", F.array_sort(F.transform(bins, lambda b: _bounds(b, low, high))))
    for i in range(1, tables):
        at = told.select(key, *place, F.explode(_open(F.col("_b"), n, most)).alias("_at"))
        met = at.join(_boxes(spots, i), F.col("_at") == F.col("above"))
        of = _bounds({c: F.col(c) for c in ("x0", "y0", "x1", "y1", "n", "bin")}, low, high)
        told = met.groupBy(key, *place).agg(F.array_sort(F.collect_list(of)).alias("_b"))
    return told


def candidates(points: DataFrame, key: str, spots: DataFrame, tables: int, n: int, most: float | None = None) -> DataFrame:
    """``key, x, y`` with every target (columns of ``spots``) of the cells that may hold some of the point's ``n`` nearest."""
    told = _last_cells(points, key, spots, tables, n, most)
    at = told.select(key, "x", "y", F.explode(_open(F.col("_b"), n, most)).alias("_at"))
    return at.join(spots, F.col("_at") == F.col(f"_leaf{tables - 1}")).drop("_at", *(f"_leaf{i}" for i in range(tables)))


def _spread(v: Column) -> Column:
    """The bits of a number below 2^DEPTH, one place apart."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v.bitwiseOR(F.shiftleft(v, by))).bitwiseAND(F.lit(mask))
    return v


def _cut(z: np.ndarray, most: int = BLOCK) -> np.ndarray:
    """The number of its block for each of sorted places ``z`` on the curve: cells of the grid are quartered until they hold ``most`` points at most."""
    block, waiting, n = np.zeros(len(z), np.int64), [(0, len(z), DEPTH)] if len(z) else [], 0
    while waiting:
        start, end, level = waiting.pop()
        if level and end - start > most:
            cell = z[start:end] >> (2 * (level - 1))
            edges = [start, *(start + np.flatnonzero(np.diff(cell)) + 1).tolist(), end]
            waiting += [(a, b, level - 1) for a, b in zip(edges, edges[1:])]
            continue
        # In one place of the finest grid there is nothing to quarter.
        for a in range(start, end, most):
            block[a : min(a + most, end)] = n
            n += 1
    return block


def blocked(points: DataFrame, box) -> DataFrame:
    """``points`` (x, y among their columns) with ``_block``, written: up to BLOCK neighbours. Parts of the curve are dealt by range and cut where they are sorted."""
    width = max(box[2] - box[0], box[3] - box[1], 1e-12)
    at = lambda v, low: F.greatest(F.least(F.floor((F.col(v) - low) / width * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)), F.lit(0)).cast("long")
    z = _spread(at("x", box[0])).bitwiseOR(F.shiftleft(_spread(at("y", box[1])), 1))
    placed_ = points.withColumn("_z", z)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def cut(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            if batch.num_rows:
                block = _cut(batch.column(batch.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block + first)], names=[*batch.schema.names[:-1], "_block"])
                first += int(block.max()) + 1

    return materialize(placed_.repartitionByRange("_z").sortWithinPartitions("_z").mapInArrow(cut, f"{schema}, _block bigint"), "blocks")


def _nearest_of(n: int, key: str, target: str):
    """Of a block's points and some targets: for each point those not farther than its n-th nearest, ties included."""

    def best(points: pa.Table, spots: pa.Table) -> pa.Table:
        x, y, tx, ty = points["x"].to_numpy(), points["y"].to_numpy(), spots["tx"].to_numpy(), spots["ty"].to_numpy()
        rows, of, found = [], [], []
        step = max(1, 4_000_000 // max(1, len(tx)))
        for a in range(0, len(x) if len(tx) else 0, step):
            d2 = (x[a : a + step, None] - tx) ** 2 + (y[a : a + step, None] - ty) ** 2
            far = np.partition(d2, n - 1, axis=1)[:, n - 1 : n] if d2.shape[1] > n else np.full((len(d2), 1), np.inf)
            i, j = np.nonzero(d2 <= far)
            rows, of, found = [*rows, i + a], [*of, j], [*found, d2[i, j]]
        i, j, d2 = (np.concatenate([np.zeros(0, kind), *part]) for part, kind in ((rows, np.int64), (of, np.int64), (found, float)))
        return pa.table([points[key].take(pa.array(i)), *(spots[c].take(pa.array(j)) for c in (target, "tx", "ty")), pa.array(d2)], names=["key", "target", "tx", "ty", "d2"])

    return best


def nearest_points(points: DataFrame, key: str, targets: DataFrame, target: str, n: int, side: float | None = None, x: str = "x", y: str = "y", most: float | None = None) -> DataFrame:
    """``key, rank, target columns, d2``: the ``n`` nearest targets (columns ``target``, tx, ty) of every point, by distance and then target.

    ``key`` tells points apart. Points and targets without coordinates, or with NaN or infinite ones, take no part. Of targets in one place the first ``n`` do. Cells
    of ``side`` or less are not halved further; ``most`` leaves out what is farther.
    """
    rest = points.select(key, finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    spots = targets.select(target, finite(F.col("tx").cast("double")).alias("tx"), finite(F.col("ty").cast("double")).alias("ty")).where("tx IS NOT NULL AND ty IS NOT NULL")
    here = Window.partitionBy("tx", "ty").orderBy(target)
    spots = materialize(spots.withColumn("_nth", F.row_number().over(here)).where(F.col("_nth") <= max(n, 1)).drop("_nth"), "targets")
    box = spots.agg(F.min("tx"), F.min("ty"), F.max("tx"), F.max("ty"), F.count("*")).first()
    if not box[4] or n < 1:
        return rest.limit(0).select(key, F.lit(0).alias("rank"), F.lit(None).cast(spots.schema[target].dataType).alias(target), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("d2"))
    told, tables = placed(spots, box, box[4], FEW, side)
    cut = blocked(rest, box)
    low, high = ("_x0", "_y0"), ("_x1", "_y1")
    boxes = cut.groupBy("_block").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    open_ = _last_cells(boxes, "_block", told, tables, n, most, low, high).select("_block", _open(F.col("_b"), n, most).alias("_at"))
    # A block that many cells are open to meets them in several parts.
    cells = materialize(open_.select("_block", F.posexplode("_at").alias("_nth", "_at")).withColumn("_part", F.floor(F.col("_nth") / math.ceil(CHUNK / FEW)).cast("int")).drop("_nth"), "open-cells")
    asked = cut.join(cells.select("_block", "_part").distinct(), "_block")
    near = cells.join(told.drop(*(f"_leaf{i}" for i in range(tables - 1))), F.col("_at") == F.col(f"_leaf{tables - 1}")).select(F.col("_block").alias("_of"), F.col("_part").alias("_for"), target, "tx", "ty")
    kinds = f"key {rest.schema[key].dataType.simpleString()}, target {spots.schema[target].dataType.simpleString()}, tx double, ty double, d2 double"
    met = asked.groupBy("_block", "_part").cogroup(near.groupBy("_of", "_for")).applyInArrow(_nearest_of(n, key, target), kinds)
    met = met.withColumnsRenamed({"key": key, "target": target})
    if most is not None:
        met = met.where(F.col("d2") <= most * most)
    best = Window.partitionBy(key).orderBy("d2", target)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(key, "rank", target, "tx", "ty", "d2")
