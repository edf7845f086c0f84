"""Matching names, codes and abbreviations of areas, and attaching what the registry knows of them.

Matching works on distinct keys: a mapping (the columns as given, ``match_key``, the area's code) is built first, by joins that AQE
broadcasts where the registry is small, and the whole input meets it once. Areas are attached by code, for several comuni share a name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from terrajobs.functions import names
from terrajobs.functions.columns import free_names, keyed, meets
from terrajobs.functions.graph import connected_components
from terrajobs.functions.markup import html_to_text
from terrajobs.functions.storage import materialize
from terrajobs.functions.text import address_parts, clean_name, english_to_italian, literal_map, loose_key, simple_name, strip_area_prefix
from terrajobs.operators.search import holders

#: A candidate needs this ratio to be one, and a match more than this with the words swapped.
CANDIDATE_RATIO, MATCH_RATIO = 0.6, 0.85


def key_column_for(kind: str, level: str) -> str:
    """The registry column that holds an identifier of a kind at a level."""
    if kind == "sigla":
        if level != "provincia":
            raise ValueError("only provinces have a sigla")
        return "sigla"
    if kind not in ("code", "name") or level not in ("comune", "provincia", "regione"):
        raise ValueError(f"no {kind!r} of {level!r}")
    return f"codice_{level}" if kind == "code" else f"denominazione_{level}"


def match_by_sigla(keys: DataFrame, column: str, registry: DataFrame, level: str = "provincia") -> DataFrame:
    """Distinct values of ``column`` with ``match_key``, the sigla that equals it but for case; null where none does."""
    sigla = key_column_for("sigla", level)
    known = registry.select(F.lower(sigla).alias("_k"), F.col(sigla).alias("match_key")).dropDuplicates(["_k"])
    return keys.select(column).distinct().join(known, F.lower(column) == F.col("_k"), "left").select(column, "match_key")


def match_by_code(keys: DataFrame, column: str, registry: DataFrame, level: str) -> DataFrame:
    """Distinct values of ``column`` with ``match_key``, the code that equals it as an integer (``001`` is 1)."""
    code = key_column_for("code", level)
    known = registry.select(F.col(code).cast("int").alias("match_key")).distinct()
    return keys.select(column).distinct().join(known, F.col(column).try_cast("int") == F.col("match_key"), "left").select(column, "match_key")


def _homonym_key(name: Column, parent: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(name)), F.lower(F.trim(parent)))


def disambiguate_homonyms(name: Column, sigla: Column | None = None, province: Column | None = None, region: Column | None = None) -> Column:
    """A homonym with a known parent as the name that tells it apart; other names, and homonyms without parent, stay."""
    out = name
    for at, parent in ((3, region), (2, province), (1, sigla)):
        if parent is not None:
            told_apart = literal_map((f"{h[0]}|{h[at]}".lower(), h[4]) for h in names.HOMONYMS)
            out = F.coalesce(F.try_element_at(told_apart, _homonym_key(name, parent)), out)
    return out


def registry_keys(registry: DataFrame, name: str, level: str) -> DataFrame:
    """``key -> match_key, code``: the cleaned names of a level. Homonymous comuni are told apart by sigla where the registry has it.

    Of areas that nothing tells apart the one of greatest (name, code) has the key; code is null where the registry has none.
    """
    plain, code = F.col(name), f"codice_{level}"
    if level == "comune" and "sigla" in registry.columns:
        plain = disambiguate_homonyms(plain, sigla=F.col("sigla"))
    number = F.col(code).cast("int") if code in registry.columns else F.lit(None).cast("int")
    rows = registry.select(strip_area_prefix(clean_name(plain), level).alias("key"), F.struct(plain.alias("match_key"), number.alias("code")).alias("m"))
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.max("m").alias("m")).select("key", "m.match_key", "m.code")


#: Kinds of parent: what the homonyms' table calls them.
PARENTS = {"sigla": "sigla", "provincia": "province", "regione": "region"}
#: Parents given as codes, and what of the registry stands for them.
CODED_PARENTS = {"codice_provincia": ("sigla", "sigla"), "codice_regione": ("denominazione_regione", "region")}


def match_by_name(
    keys: DataFrame, column: str, registry: DataFrame, level: str, *, name: str | None = None, parent: str | None = None, parent_kind: str = "provincia",
    bilingual: DataFrame | None = None, history: DataFrame | None = None,
) -> DataFrame:
    """Distinct values of ``column`` (and of the ``parent`` column) with ``match_key``, a name that tells areas apart, and
    ``codice_<level>`` where the registry has it; null where nothing matches.

    Names go through: homonyms (comuni with a parent), cleaning, prefixes, bilingual aliases, English names, earlier names (comuni
    that the registry does not have), and, still unmatched, the loose key. ``bilingual`` is (alias, name), ``history``
    (old_name, new_name); each is an equi-join on the few distinct keys. ``parent_kind`` is one of PARENTS or CODED_PARENTS.
    """
    if parent_kind not in PARENTS and parent_kind not in CODED_PARENTS:
        raise ValueError(f"a parent is one of {(*PARENTS, *CODED_PARENTS)}, not {parent_kind!r}")
    known = materialize(registry_keys(registry, name or f"denominazione_{level}", level), "registry-keys")
    given = [column] if parent is None else [column, parent]
    rows = keys.select(*given).distinct()
    plain = F.col(column).cast("string")
    if level == "comune" and parent is not None:
        told, kind = F.col(parent), PARENTS.get(parent_kind)
        if kind is None:
            source, kind = CODED_PARENTS[parent_kind]
            by_code = registry.where(F.col(source).isNotNull()).groupBy(F.col(parent_kind).cast("int").alias("_parent_code")).agg(F.min(source).alias("_parent"))
            rows, told = rows.join(by_code, F.col(parent).cast("string").try_cast("int") == F.col("_parent_code"), "left"), F.col("_parent")
        plain = disambiguate_homonyms(plain, **{kind: told})
    rows = rows.select(*given, strip_area_prefix(clean_name(plain), level).alias("_key"))
    if bilingual is not None:
        rows = rows.join(bilingual.select(F.col("alias").alias("_alias"), F.col("name").alias("_own")), F.col("_key") == F.col("_alias"), "left")
        rows = rows.withColumn("_key", F.coalesce("_own", "_key")).drop("_alias", "_own")
    rows = rows.withColumn("_key", english_to_italian(F.col("_key")))
    if level == "comune" and history is not None:
        there = known.select(F.col("key").alias("_there"))
        old = history.select(F.col("old_name").alias("_old"), F.col("new_name").alias("_new"))
        rows = rows.join(there, F.col("_key") == F.col("_there"), "left").join(old, F.col("_key") == F.col("_old"), "left")
        rows = rows.withColumn("_key", F.when(F.col("_there").isNull(), F.coalesce("_new", "_key")).otherwise(F.col("_key"))).drop("_there", "_old", "_new")
    area = F.struct("match_key", "code")
    first = rows.join(known.select(F.col("key").alias("_k1"), area.alias("_m1")), F.col("_key") == F.col("_k1"), "left")
    loose = known.groupBy(loose_key(F.col("key")).alias("_k2")).agg(F.max_by(area, "key").alias("_m2"))
    both = first.join(loose, F.when(F.col("_m1").isNull(), loose_key(F.col("_key"))) == F.col("_k2"), "left").withColumn("_m", F.coalesce("_m1", "_m2"))
    out = both.select(*given, F.col("_m.match_key").alias("match_key"), F.col("_m.code").alias(f"codice_{level}"))
    return out if f"codice_{level}" in registry.columns else out.drop(f"codice_{level}")


def not_matched(mapping: DataFrame, column: str, match: str = "match_key") -> DataFrame:
    """Distinct non-null values of ``column`` that have no match."""
    return mapping.where(F.col(column).isNotNull() & F.col(match).isNull()).select(column).distinct()


def not_in_registry(keys: DataFrame, column: str, registry: DataFrame, registry_column: str) -> DataFrame:
    """Distinct non-null values of ``column`` that the registry column does not hold."""
    known = registry.select(F.col(registry_column).alias(column)).distinct()
    return keys.where(F.col(column).isNotNull()).select(column).distinct().join(known, column, "left_anti")


def manual_match(mapping: DataFrame, column: str, by_hand: dict[str, str], level: str = "comune") -> DataFrame:
    """The mapping with values matched by hand to names of the registry; they come before what else was found.

    A code that the mapping had for such a value goes; the name stands for the area.
    """
    if not by_hand:
        return mapping
    hand, code = F.try_element_at(literal_map(by_hand.items()), F.col(column).cast("string")), f"codice_{level}"
    out = mapping.withColumn("match_key", F.coalesce(hand, "match_key"))
    return out.withColumn(code, F.when(hand.isNull(), F.col(code))) if code in mapping.columns else out


def _coded(mapping: DataFrame, registry: DataFrame, level: str) -> DataFrame:
    """The mapping with ``_match``, the matched area's code: its own, else that of the area of its name."""
    name, code = f"denominazione_{level}", f"codice_{level}"
    known = registry_keys(registry, name, level).groupBy(F.col("match_key").alias("_known")).agg(F.max("code").alias("_code"))
    own = F.col(code) if code in mapping.columns else F.lit(None).cast("int")
    return mapping.join(known, F.col("match_key") == F.col("_known"), "left").select("*", F.coalesce(own, "_code").alias("_match")).drop("_known", "_code")


def enrich_result(df: DataFrame, mapping: DataFrame, registry: DataFrame, keys: list[str], registry_key: str, *, add_missing: bool = False, drop_not_match: bool = False) -> DataFrame:
    """All of ``df`` with the registry's columns, by the mapping of its ``keys``.

    ``registry_key`` is ``denominazione_<level>``, and areas are met by that level's code where the registry has it; any other column is met itself.
    Null keys meet null keys. ``drop_not_match`` leaves out what has no match; ``add_missing`` adds areas that
    nothing matched; with neither every row of ``df`` comes once, with both the matched rows and the areas. Registry columns whose
    names ``df`` has get ``_new``, as often as it takes.
    """
    level = registry_key.removeprefix("denominazione_")
    by_code = level != registry_key and f"codice_{level}" in registry.columns
    matched = _coded(mapping, registry, level) if by_code else mapping.withColumn("_match", F.col("match_key"))
    renamed = free_names(registry.columns, df.columns)
    areas = registry.select(*(F.col(c).alias(f"_area{i}") for i, c in enumerate(registry.columns)))
    at = f"_area{registry.columns.index(f'codice_{level}' if by_code else registry_key)}"
    own = df.select(*(df[c].alias(f"_own{i}") for i, c in enumerate(df.columns)))
    kept = own.join(keyed(matched.select(*keys, "_match"), keys), meets([f"_own{df.columns.index(k)}" for k in keys]), "left")
    how = {(False, False): "left", (False, True): "inner", (True, False): "full", (True, True): "right"}[add_missing, drop_not_match]
    return kept.join(areas, F.col("_match") == F.col(at), how).select(
        *(F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)), *(F.col(f"_area{i}").alias(n) for i, n in enumerate(renamed.values()))
    )


def attach_areas(mapping: DataFrame, registry: DataFrame, level: str) -> DataFrame:
    """Matched rows of a mapping with all columns of their area, by code (by name where the registry has none); the mapping's own code goes."""
    code, name = f"codice_{level}", f"denominazione_{level}"
    found = mapping.where(F.col("match_key").isNotNull())
    if code in registry.columns:
        return _coded(found, registry, level).drop(code, "match_key").join(registry, F.col("_match") == F.col(code)).drop("_match")
    return found.join(registry, F.col("match_key") == F.col(name)).drop("match_key")


def lookup_area(keys: DataFrame, column: str, registry: DataFrame, level: str, parent: str | None = None, **aliases) -> DataFrame:
    """Distinct names of ``column`` with the attributes of their area; names without area are left out."""
    return attach_areas(match_by_name(keys, column, registry, level, parent=parent, **aliases), registry, level)


def lookup_one(spark, text: str, registry: DataFrame, level: str, **aliases) -> dict:
    """The attributes of one area by name; an unknown name raises."""
    found = lookup_area(spark.createDataFrame([(text,)], "asked string"), "asked", registry, level, **aliases).first()
    if found is None:
        raise KeyError(f"no {level} {text!r}")
    return found.asDict()


def filter_areas(areas: DataFrame, *, regione=None, provincia=None, comune=None) -> DataFrame:
    """Areas of the wanted regions, else provinces, else comuni: one or a list, as code, sigla or name in any spelling."""
    for level, wanted in (("regione", regione), ("provincia", provincia), ("comune", comune)):
        if wanted is None:
            continue
        texts = [str(w) for w in (wanted if isinstance(wanted, (list, tuple, set)) else [wanted])]
        hit = F.coalesce(clean_name(f"denominazione_{level}").isin(*(clean_name(F.lit(t)) for t in texts)), F.lit(False)) if texts else F.lit(False)
        if f"codice_{level}" in areas.columns:
            hit = hit | F.coalesce(F.col(f"codice_{level}").isin([int(t) for t in texts if t.strip().isdigit()]), F.lit(False))
        if level == "provincia" and "sigla" in areas.columns:
            hit = hit | F.coalesce(F.upper("sigla").isin([t.strip().upper() for t in texts]), F.lit(False))
        return areas.where(hit)
    return areas


def _placed_localities(
    unmatched: DataFrame, column: str, gazetteer: DataFrame, comuni: DataFrame, parent: str | None = None, parent_level: str = "provincia", in_addresses: bool = False
) -> DataFrame:
    """``column[, parent], comune, provincia`` (cleaned): the comune of localities, from a gazetteer (name, address, rank).

    An address counts where it holds the name, parses into a known comune, province and region, and agrees with the parent if
    one is given. Of several the first by rank. Addresses are those of entries of that name, or, with ``in_addresses``, all of the gazetteer that hold
    its words, which then needs no names.
    """
    asked = unmatched.select(column, *([parent] if parent else [])).where(F.col(column).isNotNull()).distinct().withColumn("_name", clean_name(column))
    if in_addresses:
        hits = holders(asked, "_name", gazetteer.select(F.col("address").alias("_address"), F.col("rank").alias("_rank")), "_address").withColumnRenamed("_name", "_gname")
        met = asked.join(hits, F.col("_name") == F.col("_gname"))
    else:
        hits = gazetteer.select(clean_name("name").alias("_gname"), F.col("address").alias("_address"), F.col("rank").alias("_rank"))
        met = asked.join(hits, (F.col("_name") == F.col("_gname")) & clean_name("_address").contains(F.col("_name")))
    good = parse_addresses(met, "_address", comuni).where(F.col("parsed_comune").isNotNull())
    if parent:
        good = good.where(strip_area_prefix(clean_name(parent), parent_level) == F.col(f"parsed_{parent_level}"))
    given = [column] + ([parent] if parent else [])
    best = good.groupBy(*given).agg(F.min(F.struct("_rank", "parsed_comune", "parsed_provincia")).alias("_b"))
    return best.select(*given, F.col("_b.parsed_comune").alias("comune"), F.col("_b.parsed_provincia").alias("provincia"))


def match_localities(unmatched: DataFrame, column: str, gazetteer: DataFrame, comuni: DataFrame, parent: str | None = None, parent_level: str = "provincia", in_addresses: bool = False) -> DataFrame:
    """``column[, parent], comune`` (cleaned): the comune of localities, as the gazetteer's first fitting address has it.

    With ``in_addresses`` a locality is searched by its words in all addresses, not only in those filed under its name.
    """
    return _placed_localities(unmatched, column, gazetteer, comuni, parent, parent_level, in_addresses).drop("provincia")


def parse_addresses(df: DataFrame, address: str, comuni: DataFrame) -> DataFrame:
    """``df`` with parsed_comune, parsed_provincia and parsed_regione: cleaned, known to the registry, all or none.

    The comune is the part before the province, else the one before that, else the province itself where it names a comune.
    """
    parts = address_parts(F.col(address))
    out = df.withColumns({f"_{k}": v for k, v in parts.items()})
    known = {
        "_comune1": comuni.select(clean_name("denominazione_comune").alias("_v")), "_comune2": comuni.select(clean_name("denominazione_comune").alias("_v")),
        "_provincia": comuni.select(clean_name("denominazione_provincia").alias("_v")), "_regione": comuni.select(clean_name("denominazione_regione").alias("_v")),
    }
    for col, values in known.items():
        out = out.join(values.distinct().withColumnRenamed("_v", f"{col}_ok"), F.col(col) == F.col(f"{col}_ok"), "left")
    also = known["_comune1"].distinct().withColumnRenamed("_v", "_as_comune")
    out = out.join(also, F.col("_provincia_ok") == F.col("_as_comune"), "left")
    comune = F.coalesce("_comune1_ok", "_comune2_ok", "_as_comune")
    whole = comune.isNotNull() & F.col("_provincia_ok").isNotNull() & F.col("_regione_ok").isNotNull()
    return out.select(*df.columns, F.when(whole, comune).alias("parsed_comune"), F.when(whole, F.col("_provincia_ok")).alias("parsed_provincia"), F.when(whole, F.col("_regione_ok")).alias("parsed_regione"))


def _most_words(df: DataFrame, name: str) -> int:
    """Words of the longest name; one row to the driver."""
    return df.agg(F.max(F.size(F.split(name, " ")))).first()[0] or 0


def locality_mentions(pages: DataFrame, most_words: int, text: str = "text") -> DataFrame:
    """``name, rest`` of every mention that says in which comune a place lies: spans of up to ``most_words`` words that end
    LOCALITY_GAP letters or less before the phrase, and the words after it up to the next mention or full stop.

    One pass over each page, whatever names are asked for.
    """
    frazione = rf"{names.FRAZIONE_WORDS[0]} (?:.{{0,{names.FRAZIONE_GAP}}} )??{names.FRAZIONE_WORDS[1]}"
    said = rf"(?:^| )(?:{'|'.join(names.LOCALITY_PHRASES)}|{frazione}) di "
    sentences = pages.select(F.explode(F.split(text, r"\.")).alias("_said")).where(F.col("_said").contains(names.FRAZIONE_WORDS[1]))
    parts = F.split(simple_name(F.col("_said")), said)
    mentions = sentences.select(parts.alias("_p")).where(F.size("_p") > 1).withColumn("_n", F.size("_p") - 1)
    sides = F.zip_with(F.slice("_p", F.lit(1), F.col("_n")), F.slice("_p", F.lit(2), F.col("_n")), lambda a, b: F.struct(F.trim(a).alias("before"), F.trim(b).alias("rest")))
    found = mentions.select(F.explode(sides).alias("m")).select("m.*")
    words, n = F.split("before", " "), F.size(F.split("before", " "))

    def ending(j: Column) -> Column:
        """Spans that end with word j, if the words after it are few."""
        after = F.length(F.array_join(F.slice(words, j + 1, n), " "))
        spans = F.transform(F.sequence(F.greatest(F.lit(1), j - most_words + 1), j), lambda i: F.array_join(F.slice(words, i, j - i + 1), " "))
        return F.when(after <= names.LOCALITY_GAP, spans).otherwise(F.array().cast("array<string>"))

    # Every word takes a letter, so no more words than letters end near enough.
    spans = F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), n - names.LOCALITY_GAP), n), ending))
    return found.where("before <> ''").select(F.explode(spans).alias("name"), "rest")


def match_localities_from_pages(
    unmatched: DataFrame, column: str, pages: DataFrame, comuni: DataFrame, html: str | None = "html", *, parent: str | None = None, parent_level: str = "provincia"
) -> DataFrame:
    """``column[, parent], comune`` (cleaned): localities that pages place in one comune and no other.

    Every prefix of the words after the phrase that names a comune is a candidate; with a parent, only comuni of that province (or
    region) are.
    """
    given = [column] + ([parent] if parent else [])
    texts = pages.select(html_to_text(html).alias("text")) if html else pages.select("text")
    asked = materialize(unmatched.where(F.col(column).isNotNull()).select(*given, clean_name(column).alias("_name")).where("_name IS NOT NULL").distinct(), "asked")
    known = comuni.select(clean_name("denominazione_comune").alias("_candidate"), clean_name(f"denominazione_{parent_level}").alias("_up")).where("_candidate IS NOT NULL")
    known = materialize((known if parent else known.select("_candidate")).distinct(), "known")
    said = locality_mentions(texts, _most_words(asked, "_name")).join(asked, F.col("name") == F.col("_name"))
    words, most = F.split("rest", " "), max(1, _most_words(known, "_candidate"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most))), lambda i: F.array_join(F.slice(words, 1, i), " "))
    met = said.select(*given, F.explode(heads).alias("_head")).distinct().join(known, F.col("_head") == F.col("_candidate"))
    if parent:
        met = met.where(strip_area_prefix(clean_name(parent), parent_level) == F.col("_up"))
    return met.groupBy(*given).agg(F.min("_candidate").alias("comune"), F.max("_candidate").alias("_other")).where("comune = _other").drop("_other")


def match_areas(
    keys: DataFrame, column: str, registry: DataFrame, level: str, *, parent: str | None = None, parent_kind: str = "provincia", gazetteer: DataFrame | None = None,
    pages: DataFrame | None = None, html: str | None = "html", similar: bool = False, **aliases,
) -> DataFrame:
    """``match_by_name`` and then, for what has no match: localities of a gazetteer and of pages (comuni), and the most similar name.

    Localities are held to a parent that is a province or region by name.
    """
    out = match_by_name(keys, column, registry, level, parent=parent, parent_kind=parent_kind, **aliases)
    name, code = f"denominazione_{level}", f"codice_{level}"
    given = [column] if parent is None else [column, parent]
    area = F.struct(F.col("match_key"), *([F.col(code)] if code in out.columns else []))

    def fill(found: DataFrame) -> DataFrame:
        """Take match_key and code of ``found`` (given, match_key, code) where there is no match yet."""
        more = keyed(found.select(*given, area.alias("_more")), given)
        both = out.join(more, meets(given), "left").withColumn("_m", F.when(F.col("match_key").isNull(), F.col("_more")).otherwise(area))
        return both.select(*given, *(F.col(f"_m.{c}").alias(c) for c in out.columns if c not in given))

    def missing() -> DataFrame:
        return materialize(out.where(F.col("match_key").isNull() & F.col(column).isNotNull()).select(*given), "unmatched")

    if level == "comune" and (gazetteer is not None or pages is not None):
        own = [F.col(code).cast("int").alias(code)] if code in out.columns else []
        areas = registry.select(clean_name(name).alias("_c"), clean_name("denominazione_provincia").alias("_p"), clean_name("denominazione_regione").alias("_r"), F.col(name).alias("match_key"), *own)
        held = parent if parent_kind in ("provincia", "regione") else None
        up = "_p" if parent_kind == "provincia" else "_r"
        best = F.max(area).alias("_a")
        if gazetteer is not None:
            places = _placed_localities(missing(), column, gazetteer, registry, held, parent_kind if held else "provincia")
            placed = missing().join(keyed(places, [column] + ([held] if held else [])), meets([column] + ([held] if held else [])))
            met = placed.join(areas, (F.col("comune") == F.col("_c")) & (F.col("provincia") == F.col("_p"))).groupBy(*given).agg(best).select(*given, "_a.*")
            out = fill(materialize(met, "localities"))
        if pages is not None:
            places = match_localities_from_pages(missing(), column, pages, registry, html, parent=held, parent_level=parent_kind if held else "provincia")
            met = places.join(areas, F.col("comune") == F.col("_c"))
            if held:
                met = met.where(strip_area_prefix(clean_name(held), parent_kind) == F.col(up))
            again = keyed(met.groupBy(*([column] + ([held] if held else []))).agg(best), [column] + ([held] if held else []))
            out = fill(materialize(missing().join(again, meets([column] + ([held] if held else []))).select(*given, "_a.*"), "localities"))
    if similar:
        words = missing().withColumn("_word", strip_area_prefix(clean_name(F.col(column).cast("string")), level))
        known = registry_keys(registry, name, level).select(F.col("key").alias("_known"), F.struct("match_key", *([F.col("code").alias(code)] if code in out.columns else [])).alias("_a"))
        near = match_by_similarity(words, "_word", known, "_known").join(known, F.col("match") == F.col("_known"))
        out = fill(materialize(words.join(near, F.col("_word") == F.col("word")).select(*given, "_a.*"), "similar"))
    return out


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="f8")


# Letters from the rarest of Italian names to the most frequent.
RARE_FIRST = "jkwxyqhzfbvupgdmcstlnreioa"


def _letters(col: str) -> Column:
    """An item for each letter and its number among equal ones, so that items shared by two words count their common multiset;
    rare items, which are high numbers and rare letters, first."""
    chars = F.filter(F.split(F.translate(col, RARE_FIRST, "abcdefghijklmnopqrstuvwxyz"), ""), lambda c: c != "")
    # Sorted, a letter's occurrences are neighbours: an item's number is its place less that of the letter's first.
    body = lambda s: F.transform(s, lambda c, i: F.concat(F.lpad((9998 - i + F.array_position(s, c)).cast("string"), 4, "0"), c))
    return F.array_sort(F.transform(F.array(F.array_sort(chars)), body)[0])


#: Texts that a word may give by deletions, at most, to meet words of one other length under them; lengths that ask for more meet under rare letters.
MOST_DELETED = 1_000


def _partners(n: int, least: float) -> list[tuple[int, int, bool]]:
    """(m, common, few): the lengths of words that can reach ``least`` with one of ``n`` letters, the letters that both must then have in one order, and
    whether few enough texts are left when the others are deleted."""
    low = least / (2 - least)
    out = []
    for m in range(max(1, math.ceil(n * low - 1e-9)), math.floor(n / low + 1e-9) + 1):
        common = math.ceil(least * (n + m) / 2 - 1e-9)
        if common <= min(n, m):
            out.append((m, common, max(math.comb(n, common), math.comb(m, common)) <= MOST_DELETED))
    return out


def _deleted(least: float, ours: bool):
    """Arrow UDF: what deletions leave of a word, with both lengths, for every length that gives few; ``ours``: whose length comes first."""

    def texts(word: str) -> list[str]:
        n = len(word)
        of = [((n, m) if ours else (m, n), common) for m, common, few in _partners(n, least) if few]
        kept = {common: {"".join(c) for c in combinations(word, common)} for common in {common for _, common in of}}
        return [f"{a} {b} {c}" for (a, b), common in of for c in kept[common]]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def told(words: pa.Array) -> pa.Array:
        return pa.array([texts(w) for w in words.to_pylist()], pa.list_(pa.string()))

    return told


def _lengths(least: float):
    """Arrow UDF: the lengths that words of a length meet under rare letters, with the letters that both must have."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("m", T.IntegerType()), T.StructField("common", T.IntegerType())])))
    def told(n: pa.Array) -> pa.Array:
        rows = [[{"m": m, "common": common} for m, common, few in _partners(x, least) if not few] for x in n.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("m", pa.int32()), ("common", pa.int32())])))

    return told


def _dealt(df: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions: names are few bytes, which Spark would else hand to one task, however much each asks of it.

    By no column, for a shuffle by columns that a step before has used is left out, and its small partitions put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def similarity_candidates(words: DataFrame, word: str, candidates: DataFrame, candidate: str, least: float = CANDIDATE_RATIO) -> DataFrame:
    """Pairs whose ratio can reach ``least``, each once, by bounds that lose none.

    What difflib matches in two words stands in both in one order, so a pair of that ratio has so many letters in common: deleting the others gives
    the same text. Words of lengths for which there are few such texts meet under these; what meets is then nearly all similar, however
    many words have the same letters. For other lengths a pair that shares enough letters shares one of the rarest few of each word, however they are chosen;
    a pair that meets under several counts under the first.
    """
    plain = lambda df, col, name: _dealt(df.select(F.col(col).alias(name)).where(f"{name} IS NOT NULL AND {name} <> ''").distinct())
    ours, theirs = plain(words, word, "word"), plain(candidates, candidate, "name")
    key = lambda df, col, first: df.withColumn("_text", F.explode(_deleted(least, first)(col))).select(col, F.xxhash64("_text").alias("_key"))
    close = key(ours, "word", True).join(key(theirs, "name", False), "_key").select("word", "name").distinct()

    def filed(df: DataFrame, name: str, items: str, n: str, m: str) -> DataFrame:
        rows = df.withColumn(n, F.length(name)).withColumn("_with", F.explode(_lengths(least)(n))).select(name, n, F.col("_with.m").alias(m), F.col("_with.common").alias("_common"))
        rows = rows.withColumn(items, _letters(name)).withColumn(f"{items}_few", F.slice(items, F.lit(1), F.size(items) - F.col("_common") + 1)).drop("_common")
        return rows.withColumn("_item", F.explode(f"{items}_few"))

    met = filed(ours, "word", "letters", "_n", "_m").join(filed(theirs, "name", "name_letters", "_m", "_n"), ["_item", "_n", "_m"])
    near = 2 * F.size(F.array_intersect("letters", "name_letters")) >= (least - 1e-9) * (F.col("_n") + F.col("_m"))
    return close.unionByName(met.where((F.col("_item") == F.array_min(F.array_intersect("letters_few", "name_letters_few"))) & near).select("word", "name"))


#: Pairs of a group of words and names that one task takes in order; larger groups are taken by rounds.
PAIRS_A_GROUP = 20_000


def _each_others_best(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, name, ratio``: pairs that are each other's best (higher ratio, then lesser word, then greater name), and those whose word and name are still free then."""
    by_word = Window.partitionBy("word").orderBy(F.desc("ratio"), F.desc("name"))
    by_name = Window.partitionBy("name").orderBy(F.desc("ratio"), "word")
    mutual = left.withColumns({"_w": F.row_number().over(by_word), "_n": F.row_number().over(by_name)}).where("_w = 1 AND _n = 1").select("word", "name", "ratio")
    mutual = materialize(mutual, "mutual")
    rest = left.join(mutual.select("word"), "word", "left_anti").join(mutual.select("name"), "name", "left_anti").select("word", "name", "ratio")
    return mutual, materialize(rest, "similar")


def _by_rounds(left: DataFrame) -> DataFrame:
    """``word, name, ratio``: pairs that are each other's best, again and again among what is left."""
    taken = left.limit(0)
    left = materialize(left, "similar")
    while not left.isEmpty():
        mutual, left = _each_others_best(left)
        taken = taken.unionByName(mutual)
    return taken


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs that come group by group and in order: those whose word and name are both free when their turn comes."""
    group, words, known = None, set(), set()
    for pairs in batches:
        keep = []
        for of, word, name in zip(pairs["_group"], pairs["word"], pairs["name"], strict=True):
            if of != group:
                group, words, known = of, set(), set()
            free = word not in words and name not in known
            keep.append(free)
            if free:
                words.add(word)
                known.add(name)
        yield pairs.loc[keep, ["word", "name", "ratio"]]


def assign_once(pairs: DataFrame, most: int = PAIRS_A_GROUP) -> DataFrame:
    """``word, name, ratio``: of the pairs, in order of ratio (then lesser word, then greater name), those whose word and name are both still free.

    Pairs that are each other's best are among them, and so are those that are so among what is left. Such rounds go on while each leaves less than a third
    of the pairs: nearly all are settled then, where names are told apart. Words and names that are linked by no chain of the other pairs do not bear on each
    other, so each connected group is taken in order by itself; groups of over ``most`` pairs by rounds to the end, which gives the same.
    """
    pairs = materialize(pairs.select("word", "name", "ratio"), "pairs")
    taken, n, left = pairs.limit(0), 0, pairs.count()
    while left and (not n or 3 * left < n):
        best, pairs = _each_others_best(pairs)
        taken, n, left = taken.unionByName(best), left, pairs.count()
    if not left:
        return taken
    ends = pairs.select(F.concat(F.lit("w"), "word").alias("src"), F.concat(F.lit("n"), "name").alias("dst"))
    groups = connected_components(ends)
    told = materialize(pairs.join(groups, F.concat(F.lit("w"), F.col("word")) == F.col("node")).select("word", "name", "ratio", F.col("component").alias("_group")), "grouped")
    large = materialize(told.groupBy("_group").count().where(F.col("count") > most).select(F.col("_group").alias("_large")), "large-groups")
    small = told.join(large, F.col("_group") == F.col("_large"), "left_anti").repartition("_group").sortWithinPartitions("_group", F.desc("ratio"), "word", F.desc("name"))
    rounds = _by_rounds(told.join(large, F.col("_group") == F.col("_large"), "left_semi").select("word", "name", "ratio"))
    return taken.unionByName(small.mapInPandas(_in_order, "word string, name string, ratio double")).unionByName(rounds)


#: Pairs are looked for at these ratios, one after the other: words that have their match at the first take no part in the wider search of the next.
STEPS = (0.96, 0.92, MATCH_RATIO)


def _scored(words: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """``word, name, score, ratio`` of pairs of ``words`` (word) and ``candidates`` (name): the ratio of the candidate to the word and, swapped, of the word to it."""
    pairs = _dealt(similarity_candidates(words, "word", candidates, "name", least))
    return materialize(pairs.withColumns({"score": _ratio("name", "word"), "ratio": _ratio("word", "name")}).where(F.col("score") >= CANDIDATE_RATIO), "scored")


def match_by_similarity(words: DataFrame, word: str, candidates: DataFrame, candidate: str, unique: bool = False) -> DataFrame:
    """``word, match, ratio``: the most similar candidate of each word whose ratio, words swapped, is above MATCH_RATIO.

    The ratio is difflib's; among equals the greatest name. With ``unique`` each candidate serves one word at most: see ``assign_once``.

    Pairs are looked for at the STEPS down to MATCH_RATIO, for a match cannot have less of a bound. The best of a word at a step is its best of all, for all others
    score less than the step; with ``unique``, pairs of a step come before all others in order, and what they take is out. Only where the best of the last step
    scores less before the swap might a candidate outside be better, and the few words of that kind are looked for again at CANDIDATE_RATIO.
    """
    left = materialize(words.select(F.col(word).alias("word")).where("word IS NOT NULL AND word <> ''").distinct(), "words")
    known = materialize(candidates.select(F.col(candidate).alias("name")).where("name IS NOT NULL AND name <> ''").distinct(), "names")
    if unique:
        free, taken = known, []
        for least in STEPS:
            pairs = _scored(left, free, least).where(F.col("ratio") > MATCH_RATIO)
            taken.append(materialize(assign_once(pairs.where(F.col("ratio") >= least)), "taken"))
            left, free = materialize(left.join(taken[-1], "word", "left_anti"), "words"), materialize(free.join(taken[-1], "name", "left_anti"), "names")
        return reduce(DataFrame.unionByName, taken).select("word", F.col("name").alias("match"), "ratio")
    found = []
    for least in STEPS:
        best = _scored(left, known, least).groupBy("word").agg(F.max(F.struct("score", "name", "ratio")).alias("b")).select("word", F.col("b.score").alias("score"), F.col("b.name").alias("match"), F.col("b.ratio").alias("ratio"))
        best = materialize(best, "best")
        sure = best.where(F.col("score") >= least)
        found.append(sure)
        left = materialize(left.join(sure, "word", "left_anti"), "words")
    unsure = best.where((F.col("score") < MATCH_RATIO) & (F.col("ratio") > MATCH_RATIO))
    if not unsure.isEmpty():
        wide = _dealt(similarity_candidates(unsure, "word", known, "name")).withColumn("score", _ratio("name", "word"))
        top = wide.groupBy(F.col("word").alias("_word")).agg(F.max(F.struct("score", "name"))["name"].alias("_top"))
        found.append(unsure.join(top, (F.col("word") == F.col("_word")) & (F.col("match") == F.col("_top")), "left_semi"))
    return reduce(DataFrame.unionByName, found).where(F.col("ratio") > MATCH_RATIO).select("word", "match", "ratio")
