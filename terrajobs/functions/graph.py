"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrajobs.functions.storage import drop, materialize


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first; loops go."""
    return edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node of its neighbourhood."""
    ends = edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    )
    least = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("least"))
    return edges.join(least, edges["lo"] == least["node"]).select("hi", F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo")))


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum, to see whether a round changed anything."""
    row = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(hi, lo) as decimal(38,0)))")).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge, the component being its smallest node.

    Rounds end when the edges are a fixed point (a forest of stars); each is written to the shared folder,
    so plans stay short and a lost executor does not undo earlier rounds. Nothing but a checksum reaches
    the driver. Loops and repeated edges do no harm; null ends are left out; no edges give no rows.
    """
    here = materialize(_oriented(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("hi"), F.col(b).alias("lo"))), "edges")
    mark = _mark(here)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        last, here = here, materialize(_oriented(_small_star(_oriented(_large_star(here)))), "edges")
        drop(last)
        before, mark = mark, _mark(here)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = here.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return here.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
