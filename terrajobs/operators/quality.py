"""Geographic data quality: checks of country, region, province, comune and coordinates, with suggested corrections."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from terrajobs.functions.columns import keyed, meets
from terrajobs.functions.storage import materialize
from terrajobs.functions.text import simple_name
from terrajobs.operators.matching import attach_areas, match_areas, match_by_name
from terrajobs.operators.spatial import locate_points

# Spellings of the country.
ITALY = ("it", "italy", "italia")
LEVELS = ("regione", "provincia", "comune")


@dataclass(frozen=True)
class Columns:
    """Which columns of a table hold what; those left out are not checked."""

    nazione: str | None = None
    regione: str | None = None
    provincia: str | None = None
    comune: str | None = None
    latitudine: str | None = None
    longitudine: str | None = None
    key: str | None = None

    def given(self) -> list[str]:
        return [v for f in fields(self) if (v := getattr(self, f.name)) is not None]


def assert_unique_key(df: DataFrame, key: str) -> None:
    """Raise where a key value repeats. One row comes to the driver."""
    again = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} is there {again[0]['count']} times")


def modal_country(df: DataFrame, column: str) -> str:
    """The most frequent spelling of Italy among the rows in Italy, the lesser of equals; ``italia`` without any. One row to the driver."""
    top = df.where(F.lower(column).isin(*ITALY)).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).collect()
    return top[0][0] if top else "italia"


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


class _Checks:
    """A frame under check: flags and suggestions are set in order, later ones over earlier ones."""

    def __init__(self, df: DataFrame):
        self.df = df

    def set(self, where: Column, **values: Column) -> None:
        where = F.coalesce(where, F.lit(False))
        self.df = self.df.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})

    def start(self, field: str, column: str) -> None:
        """``<field>_check`` says that the value is missing in Italy; no suggestion yet."""
        self.df = self.df.withColumns({f"{field}_check": F.col(column).isNull() & F.col("is_in_italy"), f"{field}_suggestion": F.lit(None).cast("string")})

    def flag(self, field: str, where: Column, suggestion: Column | None = None, keep: bool = False) -> None:
        self.set(where, **{f"{field}_check": F.lit(True)} | ({} if keep else {f"{field}_suggestion": F.lit(None).cast("string") if suggestion is None else suggestion}))


def dq_check(
    df: DataFrame, columns: Columns, comuni: DataFrame, *, areas: DataFrame | None = None, gazetteer: DataFrame | None = None, pages: DataFrame | None = None,
    history: DataFrame | None = None, sensitive: bool = False, only_warnings: bool = True, comune_tells_country: bool = False, side: float | None = None,
) -> DataFrame:
    """The distinct rows of the chosen columns with ``<column>_check`` and ``<column>_suggestion``, ``check`` and ``solved``.

    Levels are checked in turn against the registry ``comuni`` (and points against ``areas``, which has the same names and a
    geometry); what a lower level finds is compared with what the higher ones say. ``solved`` is null without a flag, true if
    every flagged column has a suggestion, false otherwise; coordinates have no suggestion. Unless ``sensitive``, values are
    compared and returned in their cleaned form. Comuni that share a name are told apart by the province, and what is found of
    them is looked up by code.
    """
    c = columns
    clean = (lambda col: col) if sensitive else simple_name
    rows = df.select(*c.given()).dropDuplicates()
    if c.nazione:
        rows = materialize(rows.withColumn(c.nazione, clean(F.col(c.nazione))), "quality")
    italy = modal_country(rows, c.nazione) if c.nazione else "italia"
    # Every level's keys come from these rows and not from the frame that earlier levels were joined to.
    base = rows = materialize(rows.withColumn("is_in_italy", F.coalesce(F.lower(c.nazione).isin(*ITALY), F.lit(False)) if c.nazione else F.lit(True)), "quality")
    q = _Checks(rows)
    if c.nazione:
        q.start(c.nazione, c.nazione)
        q.flag(c.nazione, F.col("is_in_italy") & _differs(F.col(c.nazione), F.lit(italy)), F.lit(italy))

    def attach(column: str, mapping: DataFrame, extra: list[str], found: dict[str, str]) -> None:
        """Join a mapping (column, extra parents, found names) null-safely."""
        keys = [column, *extra]
        small = keyed(mapping.select(*keys, *(F.col(a).alias(b) for a, b in found.items())), keys)
        q.df = q.df.join(small, meets(keys), "left").drop(*(f"_key{i}" for i in range(len(keys))))

    def country_from(source: str) -> None:
        if c.nazione:
            q.set(F.col(f"regione_from_{source}").isNotNull() & (F.col(c.nazione).isNull() | _differs(F.col(c.nazione), F.lit(italy))), **{
                f"{c.nazione}_check": F.lit(True), f"{c.nazione}_suggestion": F.lit(italy), "is_in_italy": F.lit(True),
            })

    if c.regione:
        q.df = q.df.withColumn(c.regione, clean(F.col(c.regione)))
        q.start(c.regione, c.regione)
        regioni = comuni.select("denominazione_regione").distinct()
        keys = base.select(clean(F.col(c.regione)).alias(c.regione))
        mapping = match_by_name(keys, c.regione, regioni, "regione").withColumn("found", clean(F.col("match_key")))
        attach(c.regione, mapping, [], {"found": "regione_from_regione"})
        found = F.col("regione_from_regione")
        q.flag(c.regione, found.isNull() & F.col("is_in_italy"), keep=True)
        q.flag(c.regione, found.isNotNull() & _differs(found, F.col(c.regione)), found)
        country_from("regione")

    if c.provincia:
        q.df = q.df.withColumn(c.provincia, clean(F.col(c.provincia)))
        q.start(c.provincia, c.provincia)
        province = comuni.groupBy("denominazione_provincia").agg(F.min("denominazione_regione").alias("denominazione_regione"))
        keys = base.select(clean(F.col(c.provincia)).alias(c.provincia))
        mapping = match_by_name(keys, c.provincia, province, "provincia").join(province, F.col("match_key") == F.col("denominazione_provincia"), "left")
        province_mapping = materialize(mapping.select(c.provincia, clean(F.col("match_key")).alias("found"), clean(F.col("denominazione_regione")).alias("above")), "provinces")
        attach(c.provincia, province_mapping, [], {"found": "provincia_from_provincia", "above": "regione_from_provincia"})
        found = F.col("provincia_from_provincia")
        q.flag(c.provincia, found.isNull() & F.col("is_in_italy"), keep=True)
        q.flag(c.provincia, found.isNotNull() & _differs(found, F.col(c.provincia)), found)
        country_from("provincia")
        if c.regione:
            low, high = F.col("regione_from_provincia"), F.col("regione_from_regione")
            q.flag(c.regione, low.isNotNull() & high.isNull(), low)
            q.flag(c.regione, low.isNotNull() & high.isNotNull() & (low != high))

    if c.comune:
        q.start(c.comune, c.comune)
        keys, parent = base.select(F.col(c.comune).alias("_name")), None
        if c.provincia:
            # The province found stands for what is said of it: "Provincia di Como" tells two comuni apart as "Como" does.
            told, parent = F.coalesce("provincia_from_provincia", c.provincia), "_told"
            q.df = q.df.withColumn("_told", told)
            keys = base.select(F.col(c.comune).alias("_name"), clean(F.col(c.provincia)).alias(c.provincia)).distinct()
            keys = keys.join(keyed(province_mapping.select(c.provincia, F.col("found").alias("provincia_from_provincia")), [c.provincia]), meets([c.provincia]), "left").select("_name", told.alias("_told"))
        registry = comuni.select("codice_comune", *(f"denominazione_{level}" for level in LEVELS), *(["sigla"] if "sigla" in comuni.columns else []))
        mapping = match_areas(keys, "_name", registry, "comune", parent=parent, history=history, gazetteer=gazetteer, pages=pages)
        up = attach_areas(mapping, registry, "comune")
        mapping = up.withColumns({level[0]: clean(F.col(f"denominazione_{level}")) for level in LEVELS}).withColumnRenamed("_name", c.comune)
        attach(c.comune, mapping, ["_told"] if parent else [], {"c": "comune_from_comune", "p": "provincia_from_comune", "r": "regione_from_comune"})
        q.df = q.df.drop("_told")
        if not comune_tells_country:
            for name in ("comune_from_comune", "provincia_from_comune", "regione_from_comune"):
                q.df = q.df.withColumn(name, F.when(F.col("is_in_italy"), F.col(name)))
        q.df = q.df.withColumn(c.comune, clean(F.col(c.comune)))
        found = F.col("comune_from_comune")
        q.flag(c.comune, found.isNull() & F.col("is_in_italy"), keep=True)
        q.flag(c.comune, found.isNotNull() & _differs(found, F.col(c.comune)), found)
        country_from("comune")
        if c.regione:
            _region_from(q, c, "comune")
        if c.provincia:
            low, high = F.col("provincia_from_comune"), F.col("provincia_from_provincia")
            q.flag(c.provincia, low.isNotNull() & high.isNull(), low)
            q.flag(c.provincia, low.isNotNull() & high.isNotNull() & (low != high))

    if c.latitudine and areas is not None:
        named = ["denominazione_comune", "denominazione_provincia", "denominazione_regione"]
        missing = (F.col(c.latitudine).isNull() | F.col(c.longitudine).isNull()) & F.col("is_in_italy")
        q.df = q.df.withColumn("coordinates_check", missing)
        spots = base.select(c.latitudine, c.longitudine).dropna().distinct()
        located = locate_points(spots, areas, named, latitude=c.latitudine, longitude=c.longitudine, side=side)
        located = located.select(c.latitudine, c.longitudine, *(clean(F.col(f"denominazione_{level}")).alias(f"{level}_from_coordinates") for level in LEVELS))
        q.df = q.df.join(located, [c.latitudine, c.longitudine], "left")
        q.set(F.col("comune_from_coordinates").isNull() & F.col("is_in_italy"), coordinates_check=F.lit(True))
        country_from("coordinates")
        if c.regione:
            _region_from(q, c, "coordinates")
        if c.provincia:
            _higher_from(q, c.provincia, "provincia", "coordinates")
        if c.comune:
            low, high = F.col("comune_from_coordinates"), F.col("comune_from_comune")
            q.flag(c.comune, low.isNotNull() & high.isNull(), low)
            q.flag(c.comune, low.isNotNull() & high.isNotNull() & (low != high))

    flags = [x for x in (c.nazione, c.regione, c.provincia, c.comune) if x]
    tests = [F.col(f"{x}_check") for x in flags] + ([F.col("coordinates_check")] if "coordinates_check" in q.df.columns else [])
    unsolved = [F.col(f"{x}_check") & F.col(f"{x}_suggestion").isNull() for x in flags] + tests[len(flags) :]
    either = lambda xs: F.greatest(*xs, F.lit(False))
    out = q.df.withColumn("check", either(tests)).withColumn("solved", F.when(F.col("check"), ~either(unsolved)))
    return out.where("check") if only_warnings else out


def _region_from(q: _Checks, c: Columns, source: str) -> None:
    _higher_from(q, c.regione, "regione", source)


def _higher_from(q: _Checks, column: str, level: str, source: str) -> None:
    """A lower source tells a level: suggest it where nothing else does; where either what the level says or an earlier
    suggestion differs, flag without suggestion."""
    low, high, said = F.col(f"{level}_from_{source}"), F.col(f"{level}_from_{level}"), F.col(f"{column}_suggestion")
    q.flag(column, low.isNotNull() & high.isNull() & said.isNull(), low)
    q.flag(column, low.isNotNull() & ((high.isNotNull() & (low != high)) | (said.isNotNull() & (low != said))))


def dq_summary(checked: DataFrame, columns: Columns) -> DataFrame:
    """``field, n_rows, n_problems, n_solved, problem_share, solved_share``: a row for all (field ``*``) and one per checked column.

    ``checked`` holds all rows, not the warnings alone.
    """
    named = [x for x in (columns.nazione, columns.regione, columns.provincia, columns.comune) if x]
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    parts = [F.struct(F.lit("*").alias("field"), count(F.col("check")).alias("n_problems"), count(F.col("solved")).alias("n_solved"))]
    parts += [F.struct(F.lit(x).alias("field"), count(F.col(f"{x}_check")).alias("n_problems"), count(F.col(f"{x}_suggestion").isNotNull()).alias("n_solved")) for x in named]
    if "coordinates_check" in checked.columns:
        parts.append(F.struct(F.lit("coordinates").alias("field"), count(F.col("coordinates_check")).alias("n_problems"), F.lit(0).cast("long").alias("n_solved")))
    one = checked.agg(F.count("*").alias("n_rows"), F.array(*parts).alias("parts"))
    rows = one.select("n_rows", F.explode("parts").alias("p")).select("p.field", "n_rows", F.coalesce("p.n_problems", F.lit(0)).alias("n_problems"), F.coalesce("p.n_solved", F.lit(0)).alias("n_solved"))
    share = lambda a, b: F.bround(F.col(a) / F.when(F.col(b) > 0, F.col(b)) * 100, 1)
    return rows.withColumns({"problem_share": share("n_problems", "n_rows"), "solved_share": share("n_solved", "n_problems")})
