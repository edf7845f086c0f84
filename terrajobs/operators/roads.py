"""Motorways, trunk roads and their exits from tagged map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrajobs.operators.spatial import line_segments, near_segments

# Road numbers that stand for another, numbers left out, and words of junctions that are no exits.
ROAD_NUMBERS = {
    "A": "RA13", "A1-R6": "A1", "R6": "A1", "A29/A": "A29racc", "A29racc/bis": "A29", "A3ì2": "A2", "A57;D25;MF;R11;R37": "A57",
    "A9;A2": "A9/A2", "E 80": "A10", "GRA": "A90", "E 45": "RA-", "S70": "RA13",
}
LEFT_OUT = ("A1-R5", "A21racc")
NOT_EXITS = ("area di servizio", "ads", "parcheggio", "polizia")


def classify_highways(features: DataFrame) -> DataFrame:
    """``id, classificazione, name, geometry`` of the lines among ``features`` (type, tags, shape, geometry).

    The number is the first of four tags, the first without blanks, ``dir`` and ``var``. Numbers with A or RA are
    Autostrada, links of motorways Congiunzione autostradale, others Superstrada.
    """
    tag = lambda k: F.col("tags")[k]
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(tag("ref"), " ", ""), "dir", ""), "var", "")
    lines = features.where("shape = 'LineString'").withColumns({"name": F.coalesce(tag("name:it"), tag("name")), "id": F.coalesce(own, tag("int_ref"), tag("nat_ref"), tag("official_ref"))})
    numbers = F.create_map(*(F.lit(x) for pair in ROAD_NUMBERS.items() for x in pair))
    lines = lines.withColumn("id", F.coalesce(F.try_element_at(numbers, F.col("id")), "id")).where(F.col("id").isNull() | ~F.col("id").isin(*LEFT_OUT))
    lines = lines.withColumn("id", F.when(F.col("name") == "Diramazione A21", F.lit("A21")).otherwise(F.col("id")))
    kind = F.when(F.col("type") == "motorway_link", "Congiunzione autostradale").when(F.coalesce(F.col("id").startswith("A") | F.col("id").startswith("RA"), F.lit(False)), "Autostrada").otherwise("Superstrada")
    return lines.select("id", kind.alias("classificazione"), "name", "geometry")


def classify_highway_exits(junctions: DataFrame, highways: DataFrame, side: float = 0.05) -> DataFrame:
    """``id, name, x, y, classificazione`` of the ``junctions`` (id, tags, x, y) that are exits on a classified line.

    An exit's name has no digit, no word of service areas and not the word "via". On a motorway or its link it is Autostrada, else on a
    trunk road Superstrada; elsewhere it is none.
    """
    name = F.coalesce(F.col("tags")["name"], F.lit(""))
    lower = F.lower(name)
    good = ~name.rlike("[0-9]") & ~lower.rlike(r"\bvia\b")
    for word in NOT_EXITS:
        good = good & ~lower.contains(word)
    exits = junctions.where(good).select("id", name.alias("name"), "x", "y").distinct()
    segments = line_segments(highways.withColumn("rank", F.when(F.col("classificazione") == "Superstrada", 1).otherwise(2)), keep=["rank"])
    on = near_segments(exits.select("id", "x", "y"), ["id", "x", "y"], segments, 0.0, "x", "y", keep=["rank"], side=side)
    best = on.groupBy("id", "x", "y").agg(F.max("rank").alias("rank"))
    return exits.join(best, ["id", "x", "y"]).select("id", "name", "x", "y", F.when(F.col("rank") == 2, "Autostrada").otherwise("Superstrada").alias("classificazione"))
