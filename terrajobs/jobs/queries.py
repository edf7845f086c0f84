"""Registered queries of the geographic jobs and the DuckDB SQL that checks them.

A query is (spark, sf_dir) -> DataFrame over tables derived from those of ``sf_dir``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrajobs.functions import geo, markup, names, sql, text
from terrajobs.functions.storage import materialize
from terrajobs.jobs.derived import derive, duck
from terrajobs.operators import geocode, maps, matching, outline, quality, registry, roads, search, spatial
from terrajobs.sources import tables

QUERIES = {}
SQL = {}

#: Side of the cells in which lattice boxes of 2.5 by 2.25 degrees are filed.
SIDE = 2.5


def registering(queries: dict, oracles: dict):
    """A decorator that registers a query under its function's name, with its SQL."""

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle is not None:
                oracles[f.__name__] = oracle
            return f

        return add

    return query


query = registering(QUERIES, SQL)


# --- the registry -------------------------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.clean_registry(derive(spark, d, "registry_raw"))


def _comuni(spark: SparkSession, d: str) -> DataFrame:
    return registry.build_comuni(_registry(spark, d), derive(spark, d, "population"), derive(spark, d, "area"))


def _regioni(spark: SparkSession, d: str) -> DataFrame:
    return registry.build_regioni(_comuni(spark, d))


_CLEAN = f"""
  SELECT CAST(codice_comune AS INT) AS codice_comune, denominazione_comune, denominazione_comune_ita_straniera, CAST(codice_provincia AS INT) AS codice_provincia,
         split_part(denominazione_provincia, '/', 1) AS denominazione_provincia, denominazione_provincia AS denominazione_provincia_ita_straniera,
         CAST(codice_regione AS INT) AS codice_regione, split_part(denominazione_regione, '/', 1) AS denominazione_regione, denominazione_regione AS denominazione_regione_ita_straniera,
         CASE WHEN lower(denominazione_provincia) = 'napoli' AND sigla IS NULL THEN 'NA' ELSE sigla END AS sigla, area_geografica
  FROM {duck("registry_raw")}"""
_COMUNI = f"SELECT * FROM ({_CLEAN}) LEFT JOIN {duck('population')} p USING (codice_comune) LEFT JOIN {duck('area')} a USING (codice_comune)"
_TOTALS = "CAST(coalesce(sum(popolazione), 0) AS BIGINT) AS popolazione, coalesce(sum(superficie_km2), 0) AS superficie_km2"
WITH = f"WITH comuni AS ({_COMUNI}) "


@query(_CLEAN)
def clean_registry(spark, d):
    return _registry(spark, d)


@query(_COMUNI)
def build_comuni(spark, d):
    return _comuni(spark, d)


@query(WITH + f"SELECT {', '.join(registry.PROVINCE_KEYS)}, {_TOTALS} FROM comuni GROUP BY ALL")
def build_province(spark, d):
    return registry.build_province(_comuni(spark, d))


@query(WITH + f"SELECT {', '.join(registry.REGION_KEYS)}, {_TOTALS} FROM comuni GROUP BY ALL")
def build_regioni(spark, d):
    return _regioni(spark, d)


@query(
    WITH + "SELECT area_geografica, denominazione_regione, denominazione_provincia, CAST(GROUPING(area_geografica, denominazione_regione, denominazione_provincia) AS BIGINT) AS level, "
    f"{_TOTALS} FROM comuni GROUP BY ROLLUP (area_geografica, denominazione_regione, denominazione_provincia)"
)
def hierarchy_rollup(spark, d):
    return registry.hierarchy_rollup(_comuni(spark, d))


@query(WITH + "SELECT denominazione_comune FROM comuni")
def area_list_comuni(spark, d):
    return registry.area_list(_comuni(spark, d), "comune")


@query(WITH + "SELECT DISTINCT denominazione_provincia FROM comuni")
def area_list_province(spark, d):
    return registry.area_list(_comuni(spark, d), "provincia")


_CHANGES = f"SELECT * FROM {duck('changes')} WHERE tipo_variazione IN ('ES', 'CD') AND NOT contains(coalesce(contenuto, ''), '{registry.SECOND_NAME_NOTICE}')"


@query(f"SELECT * REPLACE (CAST(data_decorrenza AS VARCHAR) AS data_decorrenza) FROM ({_CHANGES})")
def filter_administrative_changes(spark, d):
    return registry.filter_administrative_changes(derive(spark, d, "changes")).withColumn("data_decorrenza", F.col("data_decorrenza").cast("string"))


_HISTORY = (
    f"SELECT {sql.clean_name('denominazione_comune')} AS old_name, min(struct_pack(d := coalesce(data_decorrenza, DATE '0001-01-01'), n := {sql.clean_name('new_denominazione_comune')})).n AS new_name "
    f"FROM ({_CHANGES}) WHERE new_denominazione_comune IS NOT NULL GROUP BY 1"
)


@query(_HISTORY)
def historic_name_map(spark, d):
    return registry.historic_name_map(registry.filter_administrative_changes(derive(spark, d, "changes")))


def _bilingual(level: str, dashes: bool) -> str:
    name, full = f"denominazione_{level}", f"denominazione_{level}_ita_straniera"
    parts = f"CASE WHEN contains({full}, '/') THEN string_split({full}, '/') ELSE {f'string_split({full}, chr(45))' if dashes else f'[{full}]'} END"
    return (
        f"SELECT alias, max(name) AS name FROM (SELECT {sql.clean_name('a')} AS alias, {sql.clean_name(name)} AS name FROM (SELECT unnest({parts}) AS a, {name} FROM comuni "
        f"WHERE {name} IS DISTINCT FROM {full})) WHERE alias <> name GROUP BY 1"
    )


@query(WITH + _bilingual("comune", True))
def bilingual_name_map_comuni(spark, d):
    return registry.bilingual_name_map(_comuni(spark, d), "denominazione_comune", "denominazione_comune_ita_straniera")


@query(WITH + _bilingual("provincia", False))
def bilingual_name_map_province(spark, d):
    return registry.bilingual_name_map(_comuni(spark, d), "denominazione_provincia", "denominazione_provincia_ita_straniera", dashes=False)


@query(WITH + _bilingual("regione", False))
def bilingual_name_map_regioni(spark, d):
    return registry.bilingual_name_map(_comuni(spark, d), "denominazione_regione", "denominazione_regione_ita_straniera", dashes=False)


@query(f"SELECT CAST(Lon AS FLOAT) AS Lon, CAST(Lat AS FLOAT) AS Lat, CAST(round_even(Population * 10, 0) AS INT) / 10 AS Population FROM {duck('grid')} WHERE Population > 0")
def population_grid(spark, d):
    return tables.decode_population_grid(tables.encode_population_grid(derive(spark, d, "grid")))


# --- names ------------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {sql.clean_name('citta')} AS name FROM {duck('dirty')}")
def clean_name(spark, d):
    return derive(spark, d, "dirty").select("c_custkey", text.clean_name("citta").alias("name"))


@query(f"SELECT c_custkey, {sql.strip_area_prefix(sql.clean_name('citta'), 'comune')} AS comune, {sql.strip_area_prefix(sql.clean_name('prov'), 'provincia')} AS provincia FROM {duck('dirty')}")
def strip_area_prefix(spark, d):
    cleaned = {"comune": text.clean_name("citta"), "provincia": text.clean_name("prov")}
    return derive(spark, d, "dirty").select("c_custkey", *(text.strip_area_prefix(v, k).alias(k) for k, v in cleaned.items()))


@query(f"SELECT c_custkey, {sql.english_to_italian(sql.clean_name('citta'))} AS citta, {sql.english_to_italian(sql.clean_name('reg'))} AS reg FROM {duck('dirty')}")
def english_to_italian(spark, d):
    return derive(spark, d, "dirty").select("c_custkey", *(text.english_to_italian(text.clean_name(c)).alias(c) for c in ("citta", "reg")))


@query(f"SELECT c_custkey, {sql.loose_key(sql.clean_name('citta'))} AS loose FROM {duck('dirty')}")
def loose_key(spark, d):
    return derive(spark, d, "dirty").select("c_custkey", text.loose_key(text.clean_name("citta")).alias("loose"))


def _homonym_case(name: str, parent: str, at: int) -> str:
    cases = " ".join(f"WHEN {sql.quote(f'{h[0]}|{h[at]}'.lower())} THEN {sql.quote(h[4])}" for h in names.HOMONYMS)
    return f"(CASE lower(trim({name})) || '|' || lower(trim({parent})) {cases} ELSE {name} END)"


@query(WITH + f"SELECT codice_comune, {_homonym_case('denominazione_comune', 'sigla', 1)} AS by_sigla, {_homonym_case('denominazione_comune', 'denominazione_provincia', 2)} AS by_province FROM comuni")
def disambiguate_homonyms(spark, d):
    name = F.col("denominazione_comune")
    by_sigla, by_province = matching.disambiguate_homonyms(name, sigla=F.col("sigla")), matching.disambiguate_homonyms(name, province=F.col("denominazione_provincia"))
    return _comuni(spark, d).select("codice_comune", by_sigla.alias("by_sigla"), by_province.alias("by_province"))


_KINDS = (("code", "comune"), ("name", "comune"), ("code", "provincia"), ("name", "provincia"), ("sigla", "provincia"), ("code", "regione"), ("name", "regione"))
_KEYS = " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS kind, '{v}' AS level, CAST({'sigla' if k == 'sigla' else ('codice_' if k == 'code' else 'denominazione_') + v} AS VARCHAR) AS value FROM comuni" for k, v in _KINDS)


@query(WITH + _KEYS)
def key_columns(spark, d):
    """What of the registry every kind of identifier stands for."""
    areas, out = _comuni(spark, d), None
    for kind, level in _KINDS:
        rows = areas.select(F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.col(matching.key_column_for(kind, level)).cast("string").alias("value")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "SELECT c AS column_name, avg(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS numeric, avg(CASE WHEN regexp_matches(v, '^\\p{L}{2}$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS letters "
    f"FROM (SELECT DISTINCT 'codice' AS c, codice AS v FROM {duck('dirty')} WHERE codice IS NOT NULL UNION ALL SELECT DISTINCT 'sg', sg FROM {duck('dirty')} WHERE sg IS NOT NULL) GROUP BY 1"
)
def identifier_kind(spark, d):
    dirty = derive(spark, d, "dirty")
    shares = [text.identifier_shares(dirty.select(F.col(c).alias("v")).where("v IS NOT NULL").distinct()).select(F.lit(c).alias("column_name"), "numeric", "letters") for c in ("codice", "sg")]
    return shares[0].unionByName(shares[1])


@query(f"SELECT part, human FROM (SELECT CAST(p_partkey AS BIGINT) AS part, p_retailprice AS v, CASE WHEN p_retailprice >= 995 THEN printf('%g', round_even(p_retailprice / 100, 0) / 10) || 'K' ELSE printf('%g', round_even(p_retailprice / 10, 0) * 10) END AS human FROM part)")
def human_format(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), text.human_format(F.col("p_retailprice")).alias("human"))


def _known(level: str, source: str = "comuni", homonyms: bool = True) -> str:
    name = f"denominazione_{level}"
    plain = _homonym_case(name, "sigla", 1) if level == "comune" and homonyms else name
    return f"SELECT key, max(struct_pack(match_key := match_key, code := codice_{level})) AS m FROM (SELECT {sql.strip_area_prefix(sql.clean_name(plain), level)} AS key, {plain} AS match_key, codice_{level} FROM {source}) WHERE key IS NOT NULL GROUP BY 1"


def match_sql(col: str, source: str, level: str, *, areas: str = "comuni", parent: str | None = None, bilingual: str | None = None, history: str | None = None, homonyms: bool = True) -> str:
    """(col, [parent,] match_key, code) of the distinct values of a column: the cascade of match_by_name."""
    given = [col] + ([parent] if parent else [])
    plain = _homonym_case(col, parent, 2) if parent else f"CAST({col} AS VARCHAR)"
    rows = f"SELECT DISTINCT {', '.join(given)}, {sql.strip_area_prefix(sql.clean_name(plain), level)} AS key FROM {source}"
    of = lambda t: ", ".join(f"{t}.{g}" for g in given)
    if bilingual:
        rows = f"SELECT {of('r')}, coalesce(b.name, r.key) AS key FROM ({rows}) r LEFT JOIN ({bilingual}) b ON r.key = b.alias"
    rows = f"SELECT {', '.join(given)}, {sql.english_to_italian('key')} AS key FROM ({rows})"
    known = _known(level, areas, homonyms)
    if history:
        rows = f"SELECT {of('r')}, CASE WHEN t.key IS NULL THEN coalesce(h.new_name, r.key) ELSE r.key END AS key FROM ({rows}) r LEFT JOIN ({known}) t ON r.key = t.key LEFT JOIN ({history}) h ON r.key = h.old_name"
    loose = f"SELECT {sql.loose_key('key')} AS lk, arg_max(m, key) AS m FROM ({known}) GROUP BY 1"
    found = f"SELECT {of('r')}, coalesce(k1.m, k2.m) AS m FROM (SELECT *, {sql.loose_key('key')} AS lk FROM ({rows})) r LEFT JOIN ({known}) k1 ON r.key = k1.key LEFT JOIN ({loose}) k2 ON k1.m IS NULL AND r.lk = k2.lk"
    return f"SELECT {', '.join(given)}, m.match_key AS match_key, m.code AS codice_{level} FROM ({found})"


def _aliases(spark, d) -> dict:
    c = _comuni(spark, d)
    return {
        "bilingual": registry.bilingual_name_map(c, "denominazione_comune", "denominazione_comune_ita_straniera"),
        "history": registry.historic_name_map(registry.filter_administrative_changes(derive(spark, d, "changes"))),
    }


_CITIES = match_sql("citta", duck("dirty"), "comune", bilingual=_bilingual("comune", True), history=_HISTORY)


def _cities(spark, d) -> DataFrame:
    return matching.match_by_name(derive(spark, d, "dirty"), "citta", _comuni(spark, d), "comune", **_aliases(spark, d))


@query(WITH + _CITIES)
def match_by_name(spark, d):
    return _cities(spark, d)


@query(WITH + match_sql("prov", duck("dirty"), "provincia"))
def match_by_name_province(spark, d):
    return matching.match_by_name(derive(spark, d, "dirty"), "prov", _comuni(spark, d), "provincia")


@query(WITH + match_sql("citta", duck("dirty"), "comune", parent="prov"))
def match_by_name_with_parent(spark, d):
    return matching.match_by_name(derive(spark, d, "dirty"), "citta", _comuni(spark, d), "comune", parent="prov")


@query(WITH + f"SELECT sg, match_key FROM (SELECT DISTINCT sg FROM {duck('dirty')}) LEFT JOIN (SELECT lower(sigla) AS k, max(sigla) AS match_key FROM comuni GROUP BY 1) ON lower(sg) = k")
def match_by_sigla(spark, d):
    return matching.match_by_sigla(derive(spark, d, "dirty"), "sg", _comuni(spark, d))


@query(WITH + f"SELECT codice, match_key FROM (SELECT DISTINCT codice FROM {duck('dirty')}) LEFT JOIN (SELECT DISTINCT codice_comune AS match_key FROM comuni) ON TRY_CAST(codice AS INT) = match_key")
def match_by_code(spark, d):
    return matching.match_by_code(derive(spark, d, "dirty"), "codice", _comuni(spark, d), "comune")


@query(WITH + f"SELECT DISTINCT citta FROM ({_CITIES}) WHERE citta IS NOT NULL AND match_key IS NULL")
def not_matched(spark, d):
    return matching.not_matched(_cities(spark, d), "citta")


@query(WITH + f"SELECT DISTINCT citta FROM {duck('dirty')} x WHERE citta IS NOT NULL AND NOT EXISTS (SELECT 1 FROM comuni WHERE denominazione_comune = x.citta)")
def not_in_registry(spark, d):
    return matching.not_in_registry(derive(spark, d, "dirty"), "citta", _comuni(spark, d), "denominazione_comune")


@query(WITH + f"SELECT citta, CASE WHEN citta = 'xxxx' THEN 'Roma' ELSE match_key END AS match_key, CASE WHEN citta IS DISTINCT FROM 'xxxx' THEN codice_comune END AS codice_comune FROM ({_CITIES})")
def manual_match(spark, d):
    return matching.manual_match(_cities(spark, d), "citta", {"xxxx": "Roma"})


def _areas(spark, d) -> DataFrame:
    """Comuni as the registry has them, both Livos under one name, with a few attributes."""
    return _comuni(spark, d).select("denominazione_comune", "codice_comune", F.col("sigla").alias("sg"))


def _enrich(how: str, name: str, keys: tuple = ("citta",), **flags):
    given = ", ".join(f"x.{k}" for k in keys)
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
    mapping = _CITIES if keys == ("citta",) else match_sql("citta", duck("dirty"), "comune", parent="prov")
    oracle = (
        WITH + f", m AS ({mapping}), kept AS (SELECT x.c_custkey, {given}, x.sg, m.codice_comune AS code FROM {duck('dirty')} x LEFT JOIN m ON {same}) "
        f"SELECT kept.* EXCLUDE (code), t.denominazione_comune, t.codice_comune, t.sigla AS sg_new FROM kept {how} JOIN comuni t ON kept.code = t.codice_comune"
    )

    def run(spark, d):
        rows = derive(spark, d, "dirty").select("c_custkey", *keys, "sg")
        found = _cities(spark, d) if keys == ("citta",) else match_by_name_with_parent(spark, d)
        return matching.enrich_result(rows, found, _areas(spark, d), list(keys), "denominazione_comune", **flags)

    run.__name__ = name
    query(oracle)(run)


_enrich("LEFT", "enrich_left")
_enrich("INNER", "enrich_inner", drop_not_match=True)
_enrich("FULL", "enrich_full", add_missing=True)
_enrich("RIGHT", "enrich_right", add_missing=True, drop_not_match=True)
_enrich("LEFT", "enrich_with_parent", ("citta", "prov"))


@query(WITH + f"SELECT m.citta, c.codice_comune, c.denominazione_comune, c.popolazione FROM ({_CITIES}) m JOIN comuni c ON m.codice_comune = c.codice_comune")
def lookup_area(spark, d):
    return matching.lookup_area(derive(spark, d, "dirty"), "citta", _comuni(spark, d), "comune", **_aliases(spark, d)).select("citta", "codice_comune", "denominazione_comune", "popolazione")


# --- localities, pages, similarity ------------------------------------------------------------------------------------

def _parsed(source: str) -> str:
    listed = f"SELECT *, string_split(address, ', ') AS l FROM {source}"
    topped = f"SELECT *, len(l) - CASE WHEN len(l) > 1 AND regexp_matches(l[len(l) - 1], '^[0-9]{{5}}$') THEN 2 ELSE 1 END AS t FROM ({listed})"
    source = f"(SELECT *, starts_with(l[len(l)], 'Italia') AND t >= 3 AND NOT regexp_matches(l[t], '[0-9]') AS fits FROM ({topped}))"
    part = lambda back: sql.clean_name(f"CASE WHEN fits THEN l[t - {back}] END")
    known = lambda c: f"(SELECT {sql.clean_name(f'denominazione_{c}')} FROM comuni)"
    parts = f"SELECT *, {part(3)} AS c2, {part(2)} AS c1, {part(1)} AS p, {part(0)} AS r FROM {source}"
    found = f"SELECT *, CASE WHEN c1 IN {known('comune')} THEN c1 WHEN c2 IN {known('comune')} THEN c2 WHEN p IN {known('comune')} THEN p END AS c, p IN {known('provincia')} AND r IN {known('regione')} AS ok FROM ({parts})"
    return f"SELECT * EXCLUDE (l, t, fits, c1, c2, p, r, c, ok), CASE WHEN ok THEN c END AS parsed_comune, CASE WHEN ok AND c IS NOT NULL THEN p END AS parsed_provincia, CASE WHEN ok AND c IS NOT NULL THEN r END AS parsed_regione FROM ({found})"


@query(WITH + _parsed(duck("localities")))
def parse_address(spark, d):
    return matching.parse_addresses(derive(spark, d, "localities"), "address", _comuni(spark, d))


_ASKED = f"(SELECT DISTINCT name FROM {duck('localities')})"


@query(
    WITH + f"SELECT a.name, min(struct_pack(r := h.rank, c := h.parsed_comune)).c AS comune FROM {_ASKED} a JOIN ({_parsed(duck('localities'))}) h ON {sql.clean_name('a.name')} = {sql.clean_name('h.name')} "
    f"AND contains({sql.clean_name('h.address')}, {sql.clean_name('a.name')}) WHERE h.parsed_comune IS NOT NULL GROUP BY 1"
)
def match_localities(spark, d):
    places = derive(spark, d, "localities")
    return matching.match_localities(places.select("name").distinct(), "name", places.withColumnRenamed("name", "gname").select(F.col("gname").alias("name"), "address", "rank"), _comuni(spark, d))


@query(
    WITH + f", asked AS MATERIALIZED (SELECT nome, ' ' || {sql.clean_name('nome')} || ' ' AS asked FROM (SELECT DISTINCT split_part(name, ' ', 2) AS nome FROM {duck('localities')})), "
    f"h AS MATERIALIZED (SELECT rank, parsed_comune, ' ' || {sql.clean_name('address')} || ' ' AS said FROM ({_parsed(duck('localities'))}) WHERE parsed_comune IS NOT NULL) "
    "SELECT a.nome, min(struct_pack(r := h.rank, c := h.parsed_comune)).c AS comune FROM asked a JOIN h ON contains(h.said, a.asked) GROUP BY 1"
)
def match_localities_in_addresses(spark, d):
    """Localities asked for by a word of their name, which no entry is filed under."""
    places = derive(spark, d, "localities")
    return matching.match_localities(places.select(F.split_part("name", F.lit(" "), F.lit(2)).alias("nome")).distinct(), "nome", places, _comuni(spark, d), in_addresses=True)


_SAID_NAME = r"regexp_extract(text, 'posto (\w+) si trova', 1)"


@query(
    WITH + f", said AS (SELECT {_SAID_NAME} AS nome, regexp_extract(text, 'comune di ([^.]+)', 1) AS rest FROM {duck('said')}), "
    "heads AS (SELECT nome, array_to_string(string_split(rest, ' ')[1:i], ' ') AS candidate FROM said, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)), "
    f"met AS (SELECT DISTINCT nome, candidate FROM heads JOIN (SELECT DISTINCT {sql.clean_name('denominazione_comune')} AS k FROM comuni) ON candidate = k) "
    "SELECT nome, min(candidate) AS comune FROM met GROUP BY 1 HAVING count(*) = 1"
)
def match_localities_from_pages(spark, d):
    said = derive(spark, d, "said")
    asked = said.select(F.regexp_extract("text", r"posto (\w+) si trova", 1).alias("nome")).distinct()
    return matching.match_localities_from_pages(asked, "nome", said, _comuni(spark, d), html=None)


def _html_sql(hidden: frozenset) -> str:
    """(page_id, text) of pages as these tables have them: every tag ends, and references are of punctuation alone."""
    name, quoted = r"lower(regexp_extract(x.tok, '^</?([a-zA-Z][^\s/>]*)', 1))", lambda words: ", ".join(map(sql.quote, sorted(words)))
    within = f"CASE WHEN list_contains(s.open, {name}) THEN s.open[1:len(s.open) - list_position(list_reverse(s.open), {name})] ELSE s.open END"
    open_ = f"CASE WHEN regexp_matches(x.tok, '^(<script|<style|<!)') THEN s.open WHEN x.tok LIKE '</%' THEN {within} WHEN x.tok LIKE '<%' AND {name} NOT IN ({quoted(markup.VOID_ELEMENTS)}) THEN list_append(s.open, {name}) ELSE s.open END"
    raw = " ".join(f"WHEN x.tok LIKE '<{n}%' THEN list_append(s.out, regexp_extract(x.tok, '(?s)^[^>]*>(.*)<', 1))" for n in ("script", "style") if n not in hidden)
    shown = f"AND coalesce(s.open[-1], '') NOT IN ({quoted(hidden)})" if hidden else ""
    out = f"CASE {raw} WHEN x.tok NOT LIKE '<%' {shown} THEN list_append(s.out, x.tok) ELSE s.out END"
    tokens = "regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+')"
    state = lambda tok: f"{{'tok': {tok}, 'open': []::VARCHAR[], 'out': []::VARCHAR[]}}"
    folded = f"list_reduce(list_transform({tokens}, lambda t: {state('t')}), lambda s, x: {{'tok': x.tok, 'open': {open_}, 'out': {out}}}, {state(chr(39) * 2)})"
    plain = r"trim(regexp_replace(lower(regexp_replace(array_to_string(r.out, ' '), '&(amp|copy|middot|quot|lt|gt|nbsp);?', ' ', 'g')), '[^\p{L}\p{N}.]+', ' ', 'g'))"
    return f"SELECT page_id, CASE WHEN html IS NOT NULL THEN {plain} END AS text FROM (SELECT page_id, html, {folded} AS r FROM pages)"


@query(_html_sql(markup.HIDDEN_ELEMENTS))
def html_to_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", markup.html_to_text("html").alias("text"))


@query(_html_sql(frozenset()))
def html_to_all_text(spark, d):
    """Text of pages, scripts and heads included."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", markup.html_to_all_text("html").alias("text"))


def _misspelled(spark, d) -> DataFrame:
    """Every name of the registry, distorted by its code: a letter lost, two swapped or one put in."""
    comuni = materialize(_comuni(spark, d).select(F.lower("denominazione_comune").alias("name"), "codice_comune"), "names")
    n = F.col("name")
    half = (F.length(n) / 2).cast("int")
    code = F.col("codice_comune") % 3
    lost = F.concat(F.substring(n, F.lit(1), half), F.substring(n, half + 2, F.length(n)))
    put_in = F.concat(F.substring(n, F.lit(1), half), F.lit("x"), F.substring(n, half + 1, F.length(n)))
    swapped = F.concat(F.substring(n, F.lit(1), half), F.substring(n, half + 2, F.lit(1)), F.substring(n, half + 1, F.lit(1)), F.substring(n, half + 3, F.length(n)))
    return comuni.select(F.when(code == 0, lost).when(code == 1, put_in).otherwise(swapped).alias("word"), "name")


@query()
def match_by_similarity(spark, d):
    rows = _misspelled(spark, d)
    return matching.match_by_similarity(rows, "word", rows, "name")


@query()
def match_by_similarity_unique(spark, d):
    rows = _misspelled(spark, d)
    return matching.match_by_similarity(rows, "word", rows, "name", unique=True)


# --- geometry ---------------------------------------------------------------------------------------------------------


@query(f"SELECT *, lon AS x, lat AS y FROM {duck('points')} WHERE lat IS NOT NULL AND lon IS NOT NULL")
def to_points(spark, d):
    return spatial.to_points(derive(spark, d, "points"))


@query(f"SELECT id, lat AS latitude, lon AS longitude FROM {duck('points')}")
def find_coord_columns(spark, d):
    """Coordinates in columns of other usual names, in any case."""
    points = derive(spark, d, "points").select("id", F.col("lat").alias("Latitudine"), F.col("lon").alias("LONGITUDINE"))
    lat, lon = spatial.find_coord_columns(points)
    return points.select("id", F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))


def _boxes(spark, d) -> DataFrame:
    return derive(spark, d, "boxes").withColumn("geometry", geo.box_polygon(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))


_SYSTEMS = (4326, 32632, 3857)


@query("SELECT * FROM (VALUES " + ", ".join(f"({c}, {c})" for c in _SYSTEMS) + ") AS t(given, found)")
def detect_crs(spark, d):
    """Points in each system, and the system that they are taken for."""
    points, boxes, rows = derive(spark, d, "points"), _boxes(spark, d), None
    for crs in _SYSTEMS:
        x, y = geo.transform_crs(F.col("lon"), F.col("lat"), 4326, crs)
        there = points.select(x.alias("x"), y.alias("y"))
        row = there.agg(F.lit(crs).alias("given"), F.lit(spatial.detect_crs(there, "x", "y", boxes)).alias("found"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(f"SELECT codice, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y, round((x1 - x0) * (y1 - y0), 6) AS area FROM {duck('boxes')}")
def polygon_centroid(spark, d):
    area, x, y = geo.polygon_area_centroid(F.col("geometry"))
    return _boxes(spark, d).select("codice", F.round(x, 6).alias("center_x"), F.round(y, 6).alias("center_y"), F.round(area, 6).alias("area"))


@query(f"SELECT id, round(radians(lon) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y, lat IS NOT NULL AS returns FROM {duck('points')}")
def transform_crs(spark, d):
    """To Mercator, and to UTM and back."""
    x, y = geo.transform_crs(F.col("lon"), F.col("lat"), 4326, 3857)
    points = derive(spark, d, "points").withColumns(dict(zip(("e", "n"), geo.transform_crs(F.col("lon"), F.col("lat"), 4326, 32632), strict=True)))
    lon, lat = geo.transform_crs(F.col("e"), F.col("n"), 32632, 4326)
    returns = F.coalesce((F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8), F.lit(False))
    return points.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), returns.alias("returns"))


@query(
    f"SELECT id, CASE WHEN lat IS NOT NULL THEN round(2 * {geo.MEAN_RADIUS} * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(41.9::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(41.9::DOUBLE)) * pow(sin(radians(12.5::DOUBLE - lon) / 2), 2)))), 3) END AS metres FROM {duck('points')}"
)
def haversine_distance(spark, d):
    metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(12.5), F.lit(41.9))
    return derive(spark, d, "points").select("id", F.round(metres, 3).alias("metres"))


def _vincenty(x: str, y: str, steps: int = 8) -> str:
    """(id, metres) from (12.5, 41.9) on WGS84 by as many steps of the inverse series; points near it meet in four."""
    f, a = f"{geo.FLATTENING!r}::DOUBLE", f"{geo.A!r}::DOUBLE"
    out = f"WITH s0 AS (SELECT id, radians(12.5::DOUBLE - {x}) AS gap, radians(12.5::DOUBLE - {x}) AS lam, atan((1 - {f}) * tan(radians({y}))) AS u1, atan((1 - {f}) * tan(radians(41.9::DOUBLE))) AS u2 FROM {duck('points')}) "
    for i in range(steps):
        parts = (
            f"SELECT id, gap, u1, u2, lam, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM s{i}",
            "SELECT *, atan2(ss, cs) AS sg, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM ({})",
            "SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS mid FROM ({})",
            f"SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS c FROM ({{}})",
        )
        nested = parts[0]
        for part in parts[1:]:
            nested = part.format(nested)
        out += f", s{i + 1} AS MATERIALIZED (SELECT id, gap, u1, u2, ss, cs, sg, c2, mid, gap + (1 - c) * {f} * sa * (sg + c * ss * (mid + c * cs * (2 * mid * mid - 1))) AS lam FROM ({nested})) "
    out += f", k AS (SELECT *, c2 * (1 / pow(1 - {f}, 2) - 1) AS u FROM s{steps}), l AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM k) "
    turn = "small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))"
    return out + f"SELECT id, round({a} * (1 - {f}) * big * (sg - {turn}), 3) AS metres FROM l"


@query(_vincenty("lon", "lat"))
def geodesic_distance(spark, d):
    return derive(spark, d, "points").select("id", F.round(geo.geodesic_distance_m("lon", "lat", F.lit(12.5), F.lit(41.9)), 3).alias("metres"))


@query(
    "SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM "
    f"(SELECT round(radians(x0) * 6378137.0, 3) AS x0, round(radians(x1) * 6378137.0, 3) AS x1, round(ln(tan(pi() / 4 + radians(y0) / 2)) * 6378137.0, 3) AS y0, round(ln(tan(pi() / 4 + radians(y1) / 2)) * 6378137.0, 3) AS y1 FROM {duck('boxes')})"
)
def area_bounds(spark, d):
    bounds = spatial.area_bounds(_boxes(spark, d))
    return bounds.select(*(F.round(c, 3).alias(c) for c in bounds.columns))


@query(f"SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM {duck('boxes')} WHERE denominazione_provincia IN ('Napoli', 'Trento')")
def chosen_bounds(spark, d):
    """Bounds of two provinces, which come before a region."""
    return spatial.chosen_bounds(_boxes(spark, d), provincia=["napoli", "TRENTO "], regione="Sicilia", target=4326)


@query(f"SELECT * FROM {duck('points')} WHERE lon BETWEEN 8 AND 12 AND lat BETWEEN 40 AND 45")
def filter_bounds(spark, d):
    return spatial.filter_bounds(derive(spark, d, "points"), (8, 40, 12, 45), "lon", "lat")


@query(f"SELECT count(*) AS n_edges, round(sum(x2 - x1 + y2 - y1), 6) AS length FROM (SELECT x1, y1, x2, y2 FROM (SELECT unnest([x0, x0, x0, x1]) AS x1, unnest([y0, y1, y0, y0]) AS y1, unnest([x1, x1, x0, x1]) AS x2, unnest([y0, y1, y1, y1]) AS y2 FROM {duck('boxes')}) GROUP BY ALL HAVING count(*) = 1)")
def national_outline(spark, d):
    edges = spatial.national_outline(_boxes(spark, d))
    return edges.agg(F.count("*").alias("n_edges"), F.round(F.sum(F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")), 6).alias("length"))


def _swept(by: str) -> str:
    """(by, x1, y1, x2, y2) of the outer edges of the halves: along every line, +1 where the inside begins on its left and -1 on its right, summed up."""
    of = f"{by}, " if by else ""
    sides = (("x1", "y0", 1, "y"), ("x1", "y1", -1, "y"), ("x0", "y0", -1, "y"), ("x0", "y1", 1, "y"), ("y0", "x0", 1, "x"), ("y0", "x1", -1, "x"), ("y1", "x0", -1, "x"), ("y1", "x1", 1, "x"))
    events = " UNION ALL ".join(f"SELECT {of}'{along}' AS along, {line} AS line, {at} AS place, {n} AS n FROM {duck('halves')}" for line, at, n, along in sides)
    sums = f"SELECT {of}along, line, place, lead(place) OVER w AS upto, sum(sum(n)) OVER w AS n FROM ({events}) GROUP BY {of}along, line, place WINDOW w AS (PARTITION BY {of}along, line ORDER BY place)"
    ends = ", ".join(f"CASE along WHEN 'y' THEN {v} ELSE {h} END AS {k}" for k, v, h in (("x1", "line", "place"), ("y1", "place", "line"), ("x2", "line", "upto"), ("y2", "upto", "line")))
    return f"SELECT {of}{ends} FROM ({sums}) WHERE n <> 0"


def _halves(spark, d) -> DataFrame:
    return derive(spark, d, "halves").withColumn("geometry", geo.box_polygon(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))


@query(_swept(""))
def national_outline_t_borders(spark, d):
    """Areas beside two that stand above each other: their common border is no outline."""
    return spatial.national_outline(_halves(spark, d))


@query(
    f"SELECT denominazione_regione, round(area, 6) AS area, round(length, 6) AS length FROM (SELECT denominazione_regione, sum((x1 - x0) * (y1 - y0)) AS area FROM {duck('halves')} GROUP BY 1) "
    f"JOIN (SELECT denominazione_regione, sum(x2 - x1 + y2 - y1) AS length FROM ({_swept('denominazione_regione')}) GROUP BY 1) USING (denominazione_regione)"
)
def dissolve_regions(spark, d):
    """A polygon for each region: its area, and the length of its rings."""
    area, _, _ = geo.polygon_area_centroid(F.col("geometry"))
    length = F.aggregate(geo.polygon_edges(F.col("geometry")), F.lit(0.0), lambda acc, e: acc + F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
    return outline.dissolve(_halves(spark, d), by=["denominazione_regione"]).select("denominazione_regione", F.round(area, 6).alias("area"), F.round(length, 6).alias("length"))


@query(f"SELECT codice, CAST(CASE WHEN codice * 0.011::DOUBLE > 0.05::DOUBLE THEN 6 ELSE 5 END AS INT) AS n_vertices FROM {duck('boxes')}")
def simplify_polygon(spark, d):
    """Each box with a dent on one side, as many times 0.011 deep as its code, simplified at 0.05: dents of up to that go."""
    ring = F.col("geometry")[0][0]
    spur = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), (F.col("y0") + F.col("codice") * 0.011).alias("y"))
    bent = F.array(F.array(F.concat(F.slice(ring, 1, 1), F.array(spur), F.slice(ring, 2, 4))))
    return _boxes(spark, d).select("codice", F.size(geo.simplify_polygon(0.05)(bent)[0][0]).alias("n_vertices"))


# --- spatial joins ----------------------------------------------------------------------------------------------------

_INSIDE = "p.lon > b.x0 AND p.lon < b.x1 AND p.lat > b.y0 AND p.lat < b.y1"


@query(f"SELECT p.*, b.denominazione_provincia, b.denominazione_regione FROM {duck('points')} p LEFT JOIN {duck('boxes')} b ON {_INSIDE}")
def locate_points(spark, d):
    return spatial.locate_points(derive(spark, d, "points"), _boxes(spark, d), ["denominazione_provincia", "denominazione_regione"], side=SIDE)


@query(f"SELECT p.* FROM {duck('points')} p WHERE EXISTS (SELECT 1 FROM {duck('boxes')} b WHERE b.denominazione_regione = 'Sicilia' AND {_INSIDE})")
def points_in_areas(spark, d):
    return spatial.points_in_areas(derive(spark, d, "points"), _boxes(spark, d).where("denominazione_regione = 'Sicilia'"), ["id"], side=SIDE)


#: Stars around the middle of each box, of so many corners, with a hole of so many.
CORNERS, HOLE_CORNERS = 40, 12


def _corner(k: str, hole: bool) -> tuple[str, str]:
    """(x, y) of a corner, as SQL of both engines; every third corner of a star stands out."""
    n, far = (HOLE_CORNERS, "0.3E0") if hole else (CORNERS, f"(0.7E0 + CASE WHEN {k} % 3 = 0 THEN 0.4E0 ELSE 0.0E0 END)")
    return f"(x0 + x1) / 2 + {far} * cos({k} * {2 * math.pi / n!r}E0)", f"(y0 + y1) / 2 + {far} * sin({k} * {2 * math.pi / n!r}E0)"


def _stars_sql() -> str:
    """(codice, sx, sy, tx, ty): the sides of the stars and of their holes."""
    out = []
    for hole, n in ((False, CORNERS), (True, HOLE_CORNERS)):
        (sx, sy), (tx, ty) = _corner("k", hole), _corner(f"((k + 1) % {n})", hole)
        out.append(f"SELECT codice, {sx} AS sx, {sy} AS sy, {tx} AS tx, {ty} AS ty FROM {duck('boxes')}, (SELECT unnest(generate_series(0, {n - 1})) AS k)")
    return " UNION ALL ".join(out)


def _stars(spark, d) -> DataFrame:
    ring = lambda hole, n: f"transform(sequence(0, {n - 1}), k -> struct({_corner('k', hole)[0]} AS x, {_corner('k', hole)[1]} AS y))"
    return derive(spark, d, "boxes").withColumn("geometry", F.expr(f"array(array({ring(False, CORNERS)}, {ring(True, HOLE_CORNERS)}))"))


@query(
    f"SELECT p.id, p.lat, p.lon, s.codice FROM {duck('points')} p LEFT JOIN (SELECT q.id, e.codice FROM {duck('points')} q JOIN ({_stars_sql()}) e ON (e.sy > q.lat) <> (e.ty > q.lat) AND q.lon < (e.tx - e.sx) * (q.lat - e.sy) / (e.ty - e.sy) + e.sx "
    "GROUP BY 1, 2 HAVING count(*) % 2 = 1) s ON p.id = s.id"
)
def locate_points_in_stars(spark, d):
    """Points within many-cornered areas with a hole each."""
    return spatial.locate_points(derive(spark, d, "points").select("id", "lat", "lon"), _stars(spark, d), ["codice"], side=0.25)


RADIUS_M = 5000
_R = geo.radius_in_degrees(RADIUS_M)


@query(
    f"SELECT p.id, coalesce(n, 0) AS n_residents FROM {duck('points')} p LEFT JOIN (SELECT q.id, sum(g.Population) AS n FROM (SELECT *, floor(lon * 10) AS cx FROM {duck('points')}) q "
    f"JOIN (SELECT *, unnest([floor(Lon * 10) - 1, floor(Lon * 10), floor(Lon * 10) + 1]) AS cx FROM {duck('grid')}) g ON q.cx = g.cx AND (q.lon - g.Lon) * (q.lon - g.Lon) + (q.lat - g.Lat) * (q.lat - g.Lat) < {_R * _R!r}::DOUBLE GROUP BY 1) s ON p.id = s.id"
)
def population_nearby(spark, d):
    return spatial.population_nearby(derive(spark, d, "points"), derive(spark, d, "grid"), RADIUS_M, "id").select("id", "n_residents")


def _clusters(close: str) -> str:
    """(id, aggregation_code) by all pairs and every step that can be taken from a point."""
    return (
        f"WITH RECURSIVE p AS (SELECT id, lat, lon FROM {duck('points')} WHERE lat IS NOT NULL AND lon IS NOT NULL), "
        f"e AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON abs(a.lat - b.lat) < 0.1::DOUBLE AND {close}), "
        "reach AS (SELECT id, id AS there FROM p UNION SELECT r.id, e.dst FROM reach r JOIN e ON r.there = e.src), codes AS (SELECT id, min(there) AS aggregation_code FROM reach GROUP BY 1) "
    )


_CR = geo.radius_in_degrees(3000)
_CLOSE = f"(a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) < {_CR * _CR!r}::DOUBLE"
_CLOSE_M = f"2 * {geo.MEAN_RADIUS} * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) < 3000"


@query(_clusters(_CLOSE) + f"SELECT q.id, c.aggregation_code FROM {duck('points')} q LEFT JOIN codes c ON q.id = c.id")
def cluster_by_distance(spark, d):
    return spatial.cluster_by_distance(derive(spark, d, "points"), 3000, "id").select("id", "aggregation_code")


@query(_clusters(_CLOSE_M) + f"SELECT q.id, c.aggregation_code FROM {duck('points')} q LEFT JOIN codes c ON q.id = c.id")
def cluster_by_distance_metres(spark, d):
    return spatial.cluster_by_distance(derive(spark, d, "points"), 3000, "id", metric="haversine").select("id", "aggregation_code")


@query(_clusters(_CLOSE_M) + "SELECT count(*) AS n_groups, max(n) AS largest FROM (SELECT aggregation_code, count(*) AS n FROM codes GROUP BY 1)")
def cluster_summary(spark, d):
    return spatial.cluster_summary(spatial.cluster_by_distance(derive(spark, d, "points"), 3000, "id", metric="haversine"))


def _features(spark, d) -> DataFrame:
    """Roads as tagged map features."""
    tags = F.map_filter(F.create_map(F.lit("ref"), F.col("ref"), F.lit("int_ref"), F.col("int_ref"), F.lit("name"), F.col("nome")), lambda k, v: v.isNotNull())
    vertex = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    shape = F.when(F.col("k") % 40 == 0, "Polygon").otherwise("LineString")
    return derive(spark, d, "roads").select("k", "type", tags.alias("tags"), shape.alias("shape"), F.array(vertex(1), vertex(2)).alias("geometry"))


_NUMBER = "coalesce(replace(replace(replace(ref, ' ', ''), 'dir', ''), 'var', ''), int_ref)"
_ROADS = (
    "SELECT id, CASE WHEN type = 'motorway_link' THEN 'Congiunzione autostradale' WHEN id LIKE 'A%' OR id LIKE 'RA%' THEN 'Autostrada' ELSE 'Superstrada' END AS classificazione, nome AS name, x1, y1, x2, y2 FROM ("
    f"SELECT *, CASE WHEN nome = 'Diramazione A21' THEN 'A21' ELSE n END AS id FROM (SELECT *, CASE n0 {' '.join(f'WHEN {sql.quote(a)} THEN {sql.quote(b)}' for a, b in roads.ROAD_NUMBERS.items())} ELSE n0 END AS n FROM (SELECT *, {_NUMBER} AS n0 FROM {duck('roads')} WHERE k % 40 <> 0)) WHERE n IS NULL OR n NOT IN ('A1-R5', 'A21racc'))"
)


@query(_ROADS)
def classify_highways(spark, d):
    lines = roads.classify_highways(_features(spark, d))
    ends = {f"{c}{i + 1}": F.col("geometry")[i][c] for i in (0, 1) for c in ("x", "y")}
    return lines.select("id", "classificazione", "name", *(v.alias(k) for k, v in ends.items()))


@query(
    f"SELECT id, name, x, y, CASE max(CASE classificazione WHEN 'Superstrada' THEN 1 ELSE 2 END) WHEN 2 THEN 'Autostrada' ELSE 'Superstrada' END AS classificazione FROM ("
    f"SELECT j.k AS id, j.name, j.x1 AS x, j.y1 AS y, r.classificazione FROM (SELECT k, CASE k % 4 WHEN 0 THEN 'Uscita Nord' WHEN 1 THEN 'Area di Servizio' WHEN 2 THEN 'Uscita' ELSE 'via Roma' END AS name, x1, y1 FROM {duck('roads')}) j JOIN ({_ROADS}) r ON r.x1 = j.x1 AND r.y1 = j.y1 WHERE j.k % 2 = 0) GROUP BY 1, 2, 3, 4"
)
def classify_highway_exits(spark, d):
    """Junctions at the beginning of every road; a road is met there or nowhere, for all go the same way and begin apart."""
    name = F.when(F.col("k") % 4 == 0, "Uscita Nord").when(F.col("k") % 4 == 1, "Area di Servizio").when(F.col("k") % 4 == 2, "Uscita").otherwise("via Roma")
    junctions = derive(spark, d, "roads").select(F.col("k").alias("id"), F.create_map(F.lit("name"), name).alias("tags"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return roads.classify_highway_exits(junctions, roads.classify_highways(_features(spark, d)))


_HR = geo.radius_in_degrees(500)


def _gap2(px: str, py: str) -> str:
    t = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
    return f"pow({px} - (x1 + {t} * (x2 - x1)), 2) + pow({py} - (y1 + {t} * (y2 - y1)), 2)"


@query(f"SELECT p.id, EXISTS (SELECT 1 FROM ({_ROADS}) r WHERE r.classificazione = 'Autostrada' AND p.lon BETWEEN x1 - 0.02 AND x2 + 0.02 AND {_gap2('p.lon', 'p.lat')} < {_HR * _HR!r}::DOUBLE) AS in_highway FROM {duck('points')} p")
def points_on_highway(spark, d):
    found = spatial.points_on_highway(derive(spark, d, "points"), roads.classify_highways(_features(spark, d)), "lat", "lon", 500)
    return found.select("id", "in_highway")


_NEAREST = f"SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.lon - e.x, 2) + pow(p.lat - e.y, 2), e.id) AS rank, e.id AS exit_id, e.x, e.y, p.lon, p.lat FROM {duck('points')} p JOIN {duck('exits')} e ON p.lat IS NOT NULL"


@query(f"SELECT id, CAST(rank AS BIGINT) AS rank, exit_id FROM ({_NEAREST}) WHERE rank <= 3")
def nearest_exits(spark, d):
    near = spatial.nearest_exits(derive(spark, d, "points"), derive(spark, d, "exits"), "id", "lat", "lon", n=3)
    return near.select("id", F.posexplode("exits").alias("rank", "e")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("e.id").alias("exit_id"))


_NEAREST_MOTORWAY = _NEAREST.replace(f"{duck('exits')} e", f"(SELECT * FROM {duck('exits')} WHERE classificazione = 'Autostrada') e")


@query(
    f"SELECT p.id, CASE WHEN n.x IS NOT NULL THEN round(2 * {geo.MEAN_RADIUS} * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(n.y - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(n.y)) * pow(sin(radians(n.x - n.lon) / 2), 2)))), 3) END AS distance_m "
    f"FROM {duck('points')} p LEFT JOIN (SELECT * FROM ({_NEAREST_MOTORWAY}) WHERE rank = 1) n ON p.id = n.id"
)
def distance_to_highway(spark, d):
    found = spatial.distance_to_highway(derive(spark, d, "points"), derive(spark, d, "exits"), "id", "lat", "lon", ellipsoid=False)
    return found.select("id", F.round("distance_m", 3).alias("distance_m"))


# --- geocoding --------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, regexp_replace(address, '\\b(dell|del|d|nell|sull|sant|Sant)(\\p{{Lu}}\\S+)', '\\1''\\2', 'g') AS repaired FROM {duck('addresses')}")
def repair_apostrophes(spark, d):
    return derive(spark, d, "addresses").select("c_custkey", geocode.repair_apostrophes(F.col("address")).alias("repaired"))


def _simple(x: str) -> str:
    return rf"regexp_replace(strip_accents(regexp_replace(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+', ' ', 'g')), '[^\x00-\x7F]', '', 'g')"


_SEARCH = "CASE WHEN citta IS NULL OR contains(lower(address), lower(citta)) THEN lower(address) ELSE lower(address) || ', ' || lower(citta) END"
_GAZ = f"SELECT {_simple('address')} AS a, min(struct_pack(f := full_address, la := latitude, lo := longitude)) AS s FROM {duck('gazetteer')} GROUP BY 1"
_APOSTROPHE_SQL = r"'\b(dell|del|d|nell|sull|sant|Sant)(\p{Lu}\S+)'"
_GEOCODED = (
    f"SELECT c_custkey, address, citta, coalesce(s1, s2) AS s FROM (SELECT q.*, g1.s AS s1, g2.s AS s2 FROM (SELECT *, {_SEARCH} AS search, regexp_replace(address, {_APOSTROPHE_SQL}, '\\1''\\2', 'g') AS fixed FROM {duck('addresses')}) q "
    f"LEFT JOIN ({_GAZ}) g1 ON {_simple('q.search')} = g1.a LEFT JOIN ({_GAZ}) g2 ON g1.a IS NULL AND regexp_matches(q.address, {_APOSTROPHE_SQL}) AND {_simple('q.fixed')} = g2.a)"
)


@query(f"SELECT c_custkey, address, citta, CASE WHEN contains(lower(s.f), lower(citta)) THEN s.la END AS latitude, CASE WHEN contains(lower(s.f), lower(citta)) THEN s.lo END AS longitude FROM ({_GEOCODED})")
def geocode_addresses(spark, d):
    return geocode.geocode_addresses(derive(spark, d, "addresses"), derive(spark, d, "gazetteer"), "address", comune="citta")


@query(f"SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(word)) THEN p_retailprice END AS verified FROM (SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE split_part(p_brand, '#', 2) END AS word FROM part)")
def verify_location(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("word", F.when(F.col("p_partkey") % 5 != 0, F.split_part("p_brand", F.lit("#"), F.lit(2))))
    return part.select("p_partkey", geocode.verify_location("p_name", "p_retailprice", ["word"]).alias("verified"))


def _words_sql(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(string_split_regex({_simple(x)}, '\s+'), lambda w: w <> '')))"


def search_sql(asked: str, entries: str, least: float) -> str:
    """(text, value, score) of the texts of ``asked`` (text): by all pairs that share a word, over ``entries`` (entry, value)."""
    return (
        f"WITH e0 AS (SELECT words, min(value) AS value FROM (SELECT {_words_sql('entry')} AS words, value FROM ({entries})) WHERE len(words) > 0 GROUP BY 1), ew AS (SELECT words, unnest(words) AS word FROM e0), "
        f"wt AS (SELECT word, CAST(round({search.UNIT} * ln(1 + (SELECT count(*) FROM e0)::DOUBLE / count(*))) AS BIGINT) AS weight FROM ew GROUP BY 1), et AS (SELECT words, sum(weight) AS total FROM ew JOIN wt USING (word) GROUP BY 1), "
        f"q0 AS (SELECT text, {_words_sql('text')} AS words FROM (SELECT DISTINCT text FROM ({asked}) WHERE text IS NOT NULL)), qw AS (SELECT words, unnest(words) AS word FROM (SELECT DISTINCT words FROM q0)), qt AS (SELECT words, sum(weight) AS total FROM qw JOIN wt USING (word) GROUP BY 1), "
        "met AS (SELECT qw.words AS q, ew.words AS e, sum(weight) AS weight FROM qw JOIN ew USING (word) JOIN wt USING (word) GROUP BY 1, 2), "
        f"scored AS (SELECT q, e, 2 * met.weight::DOUBLE / (qt.total + et.total)::DOUBLE AS score FROM met JOIN qt ON q = qt.words JOIN et ON e = et.words), "
        f"best AS (SELECT q, min(struct_pack(less := -score, v := e0.value)) AS b FROM scored JOIN e0 ON e = e0.words WHERE score >= {least} GROUP BY 1) "
        "SELECT text, b.v AS value, -b.less AS score FROM q0 JOIN best ON words = q"
    )


_VARIANTS = f"SELECT {_SEARCH} AS text FROM {duck('variants')}"
_ENTRIES = f"SELECT address AS entry, struct_pack(f := full_address, la := latitude, lo := longitude) AS value FROM {duck('gazetteer')}"


@query(f"SELECT text, value.f AS full_address, value.la AS latitude, round(score, 9) AS score FROM ({search_sql(_VARIANTS, _ENTRIES, 0.7)})")
def search_addresses(spark, d):
    """Addresses in other words than the gazetteer's."""
    asked = derive(spark, d, "variants").select(geocode.search_text("address", "citta").alias("text"))
    found = search.search(asked, "text", derive(spark, d, "gazetteer"), "address", F.struct("full_address", "latitude", "longitude"), 0.7)
    return found.select("text", F.col("value.full_address").alias("full_address"), F.col("value.latitude").alias("latitude"), F.round("score", 9).alias("score"))


@query(
    f"SELECT c_custkey, address, citta, CASE WHEN contains(lower(s.f), lower(citta)) THEN s.la END AS latitude, CASE WHEN contains(lower(s.f), lower(citta)) THEN s.lo END AS longitude FROM (SELECT q.*, coalesce(g.s, n.value) AS s FROM (SELECT *, {_SEARCH} AS search FROM {duck('variants')}) q "
    f"LEFT JOIN ({_GAZ}) g ON {_simple('q.search')} = g.a LEFT JOIN ({search_sql(_VARIANTS, _ENTRIES, 0.7)}) n ON q.search = n.text)"
)
def geocode_addresses_similar(spark, d):
    return geocode.geocode_addresses(derive(spark, d, "variants"), derive(spark, d, "gazetteer"), "address", comune="citta", similar=0.7)


def _said_streets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(search, text) of texts in words: streets named after their third and fourth word, asked for with the letter of the first, and the texts, which say them."""
    named = texts.withColumns({"a": F.get("words", F.lit(2)), "b": F.get("words", F.lit(3))})
    named = named.withColumn("plain", F.coalesce(F.col("a").rlike("^[a-z]{3,}$") & F.col("b").rlike("^[a-z]{3,}$"), F.lit(False)))
    asked = named.where("plain").select(F.concat(F.lit("via "), F.substring("a", 1, 1), F.lit(". "), F.col("b")).alias("search")).distinct()
    return asked, named.select(F.concat_ws(" ", F.when(F.col("plain"), F.concat_ws(" ", F.lit("via"), "a", "b")), F.array_join("words", " ")).alias("text"))


_ROADS_SQL = ", ".join(sql.quote(x) for x in names.ROAD_PREFIXES)


def _streets_sql(texts: str) -> str:
    """(search, expanded) over the words of ``texts``: by every window of three words that begins with a road."""
    return (
        f"WITH t AS (SELECT words, coalesce(regexp_full_match(words[3], '[a-z]{{3,}}') AND regexp_full_match(words[4], '[a-z]{{3,}}'), FALSE) AS plain FROM ({texts})), asked AS (SELECT DISTINCT words[3][1] AS letter, words[4] AS name FROM t WHERE plain), "
        "said AS (SELECT CASE WHEN plain THEN list_concat(['via', words[3], words[4]], words) ELSE words END AS w FROM t), places AS (SELECT w, unnest(generate_series(1, len(w) - 2)) AS i FROM said), "
        f"windows AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS said, w[i + 1][1] AS letter, w[i + 2] AS name FROM places WHERE w[i] IN ({_ROADS_SQL}) AND regexp_full_match(w[i + 1], '[a-z]{{2,}}')) "
        "SELECT 'via ' || letter || '. ' || name AS search, min(said) AS expanded FROM asked JOIN windows USING (letter, name) GROUP BY 1 HAVING count(*) = 1"
    )


@query(_streets_sql(f"SELECT string_split(text, ' ') AS words FROM ({_html_sql(frozenset())}) WHERE text IS NOT NULL"))
def expand_abbreviations(spark, d):
    """Streets that pages say, over all pages."""
    # Both the streets and the texts are read from it, so pages become text once.
    said = materialize(spark.read.parquet(f"{d}/pages.parquet").select(markup.html_to_all_text("html").alias("text")), "page-texts")
    asked, texts = _said_streets(said.select(F.split("text", " ").alias("words")))
    return geocode.expand_abbreviations(asked, "search", texts, html=None)


@query(_streets_sql("SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL"))
def expand_abbreviations_in_documents(spark, d):
    """Streets that documents say, over the words of all documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    asked, texts = _said_streets(docs.select(F.split(F.btrim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ").alias("words")))
    return geocode.expand_abbreviations(asked, "search", texts, html=None)


@query(
    f"SELECT id, lat, lon, (n.s).address AS address, (n.s).city AS city FROM {duck('points')} p LEFT JOIN (SELECT q.id, arg_min(struct_pack(address := lower(g.full_address), city := g.city), struct_pack(d := pow(q.lon - g.longitude, 2) + pow(q.lat - g.latitude, 2), a := lower(g.full_address), c := g.city)) AS s "
    f"FROM {duck('points')} q JOIN {duck('gazetteer')} g ON pow(q.lon - g.longitude, 2) + pow(q.lat - g.latitude, 2) <= 0.0025::DOUBLE GROUP BY 1) n USING (id)"
)
def reverse_geocode(spark, d):
    points = derive(spark, d, "points").select("id", "lat", "lon")
    return geocode.reverse_geocode(points, derive(spark, d, "gazetteer"), "lat", "lon", most=0.05, side=0.05)


# --- maps -------------------------------------------------------------------------------------------------------------

_REGIONI = f"SELECT {', '.join(registry.REGION_KEYS)}, {_TOTALS} FROM comuni GROUP BY ALL"
WITH_REGIONI = WITH.rstrip() + f", regioni AS ({_REGIONI}) "
_REG = match_sql("reg", duck("dirty"), "regione", areas="regioni")
_CHOROPLETH = f"SELECT r.denominazione_regione, CAST(coalesce(v, 0) AS BIGINT) AS valore FROM regioni r LEFT JOIN (SELECT match_key, sum(valore) AS v FROM {duck('dirty')} JOIN ({_REG}) m USING (reg) GROUP BY 1) t ON r.denominazione_regione = t.match_key"


@query(WITH_REGIONI + _CHOROPLETH)
def choropleth_numeric(spark, d):
    return maps.choropleth_table(derive(spark, d, "dirty"), "reg", "valore", _regioni(spark, d), "regione").select("denominazione_regione", "valore")


def _choropleth_comuni(mapping: str, keys: tuple) -> str:
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
    return (
        WITH + f"SELECT c.denominazione_comune, c.codice_comune, CAST(coalesce(v, 0) AS BIGINT) AS valore FROM comuni c LEFT JOIN (SELECT m.codice_comune, sum(x.valore) AS v FROM {duck('dirty')} x JOIN ({mapping}) m ON {same} "
        "WHERE x.citta IS NOT NULL AND m.codice_comune IS NOT NULL GROUP BY 1) t ON c.codice_comune = t.codice_comune"
    )


@query(_choropleth_comuni(match_sql("citta", duck("dirty"), "comune"), ("citta",)))
def choropleth_comuni(spark, d):
    out = maps.choropleth_table(derive(spark, d, "dirty"), "citta", "valore", _comuni(spark, d), "comune")
    return out.select("denominazione_comune", "codice_comune", "valore")


@query(_choropleth_comuni(match_sql("citta", duck("dirty"), "comune", parent="prov"), ("citta", "prov")))
def choropleth_comuni_with_parent(spark, d):
    out = maps.choropleth_table(derive(spark, d, "dirty"), "citta", "valore", _comuni(spark, d), "comune", parent="prov")
    return out.select("denominazione_comune", "codice_comune", "valore")


@query(
    WITH + f", m AS ({match_sql('citta', duck('dirty'), 'comune', parent='prov')}) SELECT (SELECT CAST(sum(x.valore) AS BIGINT) FROM {duck('dirty')} x JOIN m ON x.citta = m.citta AND x.prov IS NOT DISTINCT FROM m.prov WHERE m.match_key IS NOT NULL) AS shown"
)
def choropleth_sum(spark, d):
    """The sum over the map is that of the rows that match: no area's total is shown twice."""
    return choropleth_comuni_with_parent(spark, d).agg(F.sum("valore").alias("shown"))


_SEGMENTS = f"(SELECT reg, CASE WHEN length(reg) % 2 = 0 THEN 'pari' ELSE 'dispari' END AS tipo FROM (SELECT denominazione_regione AS reg FROM regioni))"


@query(WITH_REGIONI + f"SELECT denominazione_regione, tipo, CAST(color AS INT) AS color FROM {_SEGMENTS} s JOIN regioni ON reg = denominazione_regione JOIN (SELECT tipo, row_number() OVER (ORDER BY count(*) DESC, tipo) - 1 AS color FROM {_SEGMENTS} GROUP BY 1) USING (tipo)")
def choropleth_categories(spark, d):
    areas = _regioni(spark, d)
    said = areas.select(F.col("denominazione_regione").alias("reg"), F.when(F.length("denominazione_regione") % 2 == 0, "pari").otherwise("dispari").alias("tipo"))
    return maps.choropleth_categories(said, "reg", "tipo", areas, "regione").select("denominazione_regione", "tipo", "color")


@query(WITH_REGIONI + f"SELECT denominazione_regione, coalesce(x.valore, 0) AS valore, coalesce(x.citta, '-') AS citta FROM regioni LEFT JOIN (SELECT match_key, valore, citta FROM {duck('dirty')} JOIN ({_REG}) USING (reg)) x ON denominazione_regione = match_key")
def choropleth_table_multi(spark, d):
    return maps.choropleth_table_multi(derive(spark, d, "dirty"), "reg", ["valore", "citta"], _regioni(spark, d), "regione").select("denominazione_regione", "valore", "citta")


@query(WITH + "SELECT codice_comune, denominazione_comune FROM comuni WHERE lower(denominazione_regione) IN ('lombardia', 'sicilia')")
def filter_areas(spark, d):
    return maps.filter_areas(_comuni(spark, d), regione=["lombardia ", "SICILIA"]).select("codice_comune", "denominazione_comune")


@query(WITH_REGIONI + "SELECT denominazione_regione, codice_regione FROM regioni WHERE denominazione_regione IN (SELECT denominazione_regione FROM comuni WHERE sigla = 'CO')")
def parent_overlays(spark, d):
    chosen = maps.filter_areas(_comuni(spark, d), provincia="co")
    return maps.parent_overlays(_regioni(spark, d), chosen, "regione").select("denominazione_regione", "codice_regione")


@query(
    WITH_REGIONI + f"SELECT denominazione_regione, valore, printf('%.1f', round_even(valore / CAST(total AS DOUBLE) * 100, 1)) || '%' AS label, CASE WHEN lower(denominazione_regione) IN ('calabria', 'liguria') OR valore <= (hi + lo) / 2.0::DOUBLE THEN 'black' ELSE 'white' END AS color "
    f"FROM (SELECT *, sum(valore) OVER () AS total, max(valore) OVER () AS hi, min(valore) OVER () AS lo FROM ({_CHOROPLETH})) WHERE valore > 0"
)
def map_labels(spark, d):
    return maps.map_labels(choropleth_numeric(spark, d), "denominazione_regione", "valore", percent=True)


@query(
    f"SELECT segmento, lat, lon, round(radians(lon) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y FROM {duck('points')} p WHERE lat IS NOT NULL AND EXISTS (SELECT 1 FROM {duck('boxes')} b WHERE b.denominazione_provincia = 'Napoli' AND {_INSIDE})"
)
def point_map_table(spark, d):
    napoli = maps.filter_areas(_boxes(spark, d), provincia="napoli ")
    out = maps.point_map_table(derive(spark, d, "points"), "lat", "lon", ["segmento"], areas=napoli, side=SIDE)
    return out.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query(f"SELECT CAST(min(valore) - (max(valore) - min(valore)) / 5.0::DOUBLE AS DOUBLE) AS low, CAST(max(valore) AS DOUBLE) AS high FROM {duck('points')}")
def color_domain(spark, d):
    return maps.color_domain(derive(spark, d, "points"), "valore")


@query(f"SELECT count(DISTINCT segmento) AS n_values, CASE WHEN count(DISTINCT segmento) <= 10 THEN 10 ELSE 20 END AS palette FROM {duck('points')}")
def color_domain_text(spark, d):
    return maps.color_domain(derive(spark, d, "points"), "segmento")


def _density_sql(scale: str, z: str, value: bool) -> str:
    n = 19
    w = "greatest(CAST(valore AS DOUBLE), 1e-5::DOUBLE)" if value else "1.0::DOUBLE"
    taps = ", ".join(f"({k}, {g / sum(maps.SMOOTHING)!r}::DOUBLE)" for k, g in zip(range(-4, 5), maps.SMOOTHING, strict=True))
    back = lambda a: f"CASE WHEN (({a} + k) % {2 * n} + {2 * n}) % {2 * n} >= {n} THEN {2 * n - 1} - (({a} + k) % {2 * n} + {2 * n}) % {2 * n} ELSE (({a} + k) % {2 * n} + {2 * n}) % {2 * n} END"
    return (
        f"WITH p AS (SELECT lon, lat, {w} AS w FROM {duck('points')} WHERE lat IS NOT NULL), b AS (SELECT min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1, sum(w) total, max(w) top FROM p), "
        f"c AS (SELECT CAST(least(floor((lon - x0) / (x1 - x0) * {n}), {n - 1}) AS INT) AS ix, CAST(least(floor((lat - y0) / (y1 - y0) * {n}), {n - 1}) AS INT) AS iy, ln(sum(w) * (10000.0::DOUBLE / any_value({scale}))) AS z FROM p, b GROUP BY 1, 2), "
        f"t(k, g) AS (VALUES {taps}), sx AS (SELECT {back('ix')} AS ix, iy, sum(z * g) AS z FROM c, t GROUP BY 1, 2), sy AS (SELECT ix, {back('iy')} AS iy, sum(z * g) AS z FROM sx, t GROUP BY 1, 2) "
        f"SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round({z}, 6) AS z FROM sy"
    )


@query(_density_sql("total", "CASE WHEN z > 0 THEN z END", False))
def density_grid(spark, d):
    out = maps.density_grid(derive(spark, d, "points"), "lon", "lat", nx=20, ny=20)
    return out.withColumn("z", F.round("z", 6))


@query(_density_sql("top", "CASE WHEN z > 0 THEN z ELSE 0.0::DOUBLE END", True))
def density_grid_interactive(spark, d):
    out = maps.density_grid(derive(spark, d, "points"), "lon", "lat", "valore", nx=20, ny=20, interactive=True)
    return out.withColumn("z", F.round("z", 6))


# --- data quality -----------------------------------------------------------------------------------------------------

_DQ_COLUMNS = quality.Columns(nazione="nazione", regione="regione", provincia="provincia", comune="comune", latitudine="latitudine", longitudine="longitudine", key="id")
# Rows with planted errors: spellings, missing and wrong parents, points elsewhere, foreign rows.
_DQ_ROWS = f"""
    SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'ITALY' WHEN 1 THEN 'Francia' WHEN 2 THEN NULL ELSE 'Italia' END AS nazione,
           CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Lombardy' WHEN 2 THEN 'Nowhere' ELSE r.denominazione_regione END AS regione,
           CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Provincia di ' || r.denominazione_provincia WHEN 2 THEN 'Trento' ELSE r.denominazione_provincia END AS provincia,
           CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'Comune di ' || r.denominazione_comune WHEN 2 THEN 'Atlantide' ELSE upper(r.denominazione_comune) END AS comune,
           CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE b.y0 + 1.0E0 END AS latitudine, CASE WHEN c_custkey % 9 = 8 THEN b.x0 + 30.0E0 ELSE b.x0 + 1.0E0 END AS longitudine
    FROM {{customer}} c JOIN {{told}} r ON r.codice_comune = c_custkey % 90 + 1 JOIN {{boxes}} b ON b.codice + 1 = r.codice_provincia"""
_DQ_TOLD = "SELECT denominazione_comune, codice_comune, codice_provincia, denominazione_provincia, denominazione_regione FROM comuni"
#: Boxes with a comune in each: the least of its province.
_DQ_AREAS = "SELECT min(c.denominazione_comune) AS denominazione_comune, c.denominazione_provincia, min(c.denominazione_regione) AS denominazione_regione, b.x0, b.y0, b.x1, b.y1 FROM {comuni} c JOIN {boxes} b ON b.codice + 1 = c.codice_provincia GROUP BY c.denominazione_provincia, b.x0, b.y0, b.x1, b.y1"


def _dq_rows(spark, d) -> DataFrame:
    customer = spark.read.parquet(f"{d}/customer.parquet")
    return spark.sql(_DQ_ROWS.format(customer="{customer}", told="{told}", boxes="{boxes}"), customer=customer, told=_comuni(spark, d), boxes=derive(spark, d, "boxes"))


def _dq(spark, d, columns: quality.Columns, **options) -> DataFrame:
    areas = spark.sql(_DQ_AREAS, comuni=_comuni(spark, d), boxes=derive(spark, d, "boxes"))
    areas = areas.withColumn("geometry", geo.box_polygon(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    return quality.dq_check(_dq_rows(spark, d), columns, _comuni(spark, d), areas=areas, only_warnings=False, side=SIDE, **options)


_WITH_DQ = WITH.rstrip() + f", told AS ({_DQ_TOLD}), rows AS ({_DQ_ROWS.format(customer='customer', told='told', boxes=duck('boxes'))}) "
_IT = "('it', 'italy', 'italia')"


def _solved(flags: list[tuple[str, str | None]]) -> str:
    """check and solved from (flag, suggestion) expressions."""
    any_flag = " OR ".join(f for f, _ in flags)
    open_flag = " OR ".join(f"({f}{'' if s is None else f' AND {s} IS NULL'})" for f, s in flags)
    return f"({any_flag}) AS \"check\", CASE WHEN {any_flag} THEN NOT ({open_flag}) END AS solved"


@query(
    _WITH_DQ + f", c AS (SELECT id, {_simple('nazione')} AS nazione FROM rows), italy AS (SELECT nazione AS it FROM c WHERE nazione IN {_IT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    f"SELECT id, nazione, coalesce(nazione IN {_IT}, FALSE) AS is_in_italy, coalesce(nazione IN {_IT} AND nazione <> it, FALSE) AS nazione_check, CASE WHEN nazione IN {_IT} AND nazione <> it THEN it END AS nazione_suggestion FROM c, italy"
)
def dq_country(spark, d):
    return _dq(spark, d, quality.Columns(nazione="nazione", key="id")).drop("check", "solved")


def _dq_level(level: str) -> str:
    """One level alone, without a country: everything is in Italy. A comune is matched as given and cleaned afterwards; its name is that of its code."""
    given = level if level == "comune" else _simple(level)
    found = match_sql(level, "q", level)
    said = _simple(f"q.{level}")
    named = f"SELECT x.{level}, {_simple('n.name')} AS found FROM ({found}) x LEFT JOIN (SELECT DISTINCT codice_{level} AS code, denominazione_{level} AS name FROM comuni) n ON x.codice_{level} = n.code"
    return (
        _WITH_DQ + f", q AS (SELECT id, {given} AS {level} FROM rows), m AS ({named}), "
        f"f AS (SELECT q.id, {said} AS {level}, m.found, q.{level} IS NULL OR m.found IS NULL OR m.found <> {said} AS flag, CASE WHEN m.found <> {said} THEN m.found END AS said FROM q LEFT JOIN m ON q.{level} IS NOT DISTINCT FROM m.{level}) "
        f"SELECT id, {level}, flag AS {level}_check, said AS {level}_suggestion, {_solved([('flag', 'said')])} FROM f"
    )


def _dq_one(level: str):
    def run(spark, d):
        checked = _dq(spark, d, quality.Columns(**{level: level}, key="id"))
        return checked.select("id", level, f"{level}_check", f"{level}_suggestion", "check", "solved")

    run.__name__ = f"dq_{level}"
    query(_dq_level(level))(run)


for _level in quality.LEVELS:
    _dq_one(_level)


@query(
    _WITH_DQ + f", q AS (SELECT id, {_simple('provincia')} AS provincia, comune FROM rows), mp AS (SELECT provincia, {_simple('match_key')} AS fp FROM ({match_sql('provincia', 'q', 'provincia')})), "
    "t AS (SELECT q.*, mp.fp, coalesce(mp.fp, q.provincia) AS told FROM q LEFT JOIN mp ON q.provincia IS NOT DISTINCT FROM mp.provincia), "
    f"mc AS (SELECT x.comune, x.told, {_simple('n.denominazione_comune')} AS fc, {_simple('n.denominazione_provincia')} AS up FROM ({match_sql('comune', 't', 'comune', parent='told')}) x JOIN comuni n ON x.codice_comune = n.codice_comune), "
    f"f AS (SELECT t.id, t.provincia, t.fp, mc.fc, mc.up, {_simple('t.comune')} AS said FROM t LEFT JOIN mc ON t.comune IS NOT DISTINCT FROM mc.comune AND t.told IS NOT DISTINCT FROM mc.told) "
    "SELECT id, fc IS NULL OR fc IS DISTINCT FROM said AS comune_check, CASE WHEN fc <> said THEN fc END AS comune_suggestion, "
    "provincia IS NULL OR fp IS NULL OR fp <> provincia OR (up IS NOT NULL AND up <> fp) AS provincia_check, "
    "CASE WHEN up IS NOT NULL AND fp IS NULL THEN up WHEN up IS NOT NULL AND up <> fp THEN NULL WHEN fp <> provincia THEN fp END AS provincia_suggestion FROM f"
)
def dq_comune_with_parent(spark, d):
    checked = _dq(spark, d, quality.Columns(provincia="provincia", comune="comune", key="id"))
    return checked.select("id", "comune_check", "comune_suggestion", "provincia_check", "provincia_suggestion")


@query(
    _WITH_DQ + f", areas AS ({_DQ_AREAS.format(comuni='comuni', boxes=duck('boxes'))}) SELECT id, a.denominazione_comune IS NULL AS coordinates_check, {_simple('a.denominazione_comune')} AS comune_from_coordinates "
    "FROM rows LEFT JOIN areas a ON longitudine > x0 AND longitudine < x1 AND latitudine > y0 AND latitudine < y1"
)
def dq_coordinates(spark, d):
    checked = _dq(spark, d, quality.Columns(latitudine="latitudine", longitudine="longitudine", key="id"))
    return checked.select("id", "coordinates_check", "comune_from_coordinates")


@query(
    _WITH_DQ + f", q AS (SELECT id, {_simple('regione')} AS regione, {_simple('provincia')} AS provincia FROM rows), mr AS (SELECT regione, {_simple('match_key')} AS fr FROM ({match_sql('regione', 'q', 'regione')})), "
    f"mp AS (SELECT provincia, {_simple('match_key')} AS fp, {_simple('(SELECT min(denominazione_regione) FROM comuni WHERE denominazione_provincia = match_key)')} AS up FROM ({match_sql('provincia', 'q', 'provincia')})), "
    "f AS (SELECT q.*, fr, fp, up, q.regione IS NULL OR fr IS NULL OR fr <> q.regione AS r0, CASE WHEN fr <> q.regione THEN fr END AS s0 FROM q LEFT JOIN mr ON q.regione IS NOT DISTINCT FROM mr.regione LEFT JOIN mp ON q.provincia IS NOT DISTINCT FROM mp.provincia) "
    "SELECT id, r0 OR (up IS NOT NULL AND (fr IS NULL OR fr <> up)) AS regione_check, CASE WHEN up IS NOT NULL AND fr IS NULL THEN up WHEN up <> fr THEN NULL ELSE s0 END AS regione_suggestion FROM f"
)
def dq_cross_hierarchy(spark, d):
    checked = _dq(spark, d, quality.Columns(regione="regione", provincia="provincia", key="id"))
    return checked.select("id", "regione_check", "regione_suggestion")


def _dq_steps() -> list[tuple[str, dict[str, str]]]:
    """The whole report as (condition, {column: value}) steps in turn, each over what the steps before it left."""

    def flag(level: str, where: str, suggestion: str | None = "NULL") -> tuple[str, dict[str, str]]:
        return where, {f"{level}_check": "TRUE"} | ({} if suggestion is None else {f"{level}_suggestion": suggestion})

    def country(region: str) -> tuple[str, dict[str, str]]:
        return f"{region} IS NOT NULL AND nazione IS DISTINCT FROM it", {"nazione_check": "TRUE", "nazione_suggestion": "it", "is_in_italy": "TRUE"}

    def own(level: str) -> list:
        found = f"{level}_from_{level}"
        return [flag(level, f"{level} IS NULL AND is_in_italy", None), flag(level, f"{found} IS NULL AND is_in_italy", None), flag(level, f"{found} <> {level} OR ({found} IS NOT NULL AND {level} IS NULL)", found)]

    def parent(level: str, low: str) -> list:
        high = f"{level}_from_{level}"
        return [flag(level, f"{low} IS NOT NULL AND {high} IS NULL", low), flag(level, f"{low} <> {high}")]

    def higher(level: str, low: str) -> list:
        high, said = f"{level}_from_{level}", f"{level}_suggestion"
        return [flag(level, f"{low} IS NOT NULL AND {high} IS NULL AND {said} IS NULL", low), flag(level, f"{low} <> {high} OR {low} <> {said}")]

    only_italy = {f"{level}_from_comune": "NULL" for level in quality.LEVELS}
    return [
        flag("nazione", "is_in_italy AND nazione <> it", "it"), *own("regione"), country("regione_from_regione"), *own("provincia"), country("regione_from_provincia"), *parent("regione", "regione_from_provincia"),
        ("NOT is_in_italy", only_italy), *own("comune"), country("regione_from_comune"), *higher("regione", "regione_from_comune"), *parent("provincia", "provincia_from_comune"),
        ("(latitudine IS NULL OR longitudine IS NULL) AND is_in_italy", {"coordinates_check": "TRUE"}), ("comune_from_coordinates IS NULL AND is_in_italy", {"coordinates_check": "TRUE"}),
        country("regione_from_coordinates"), *higher("regione", "regione_from_coordinates"), *higher("provincia", "provincia_from_coordinates"), *parent("comune", "comune_from_coordinates"),
    ]


def _dq_full() -> str:
    """CTEs up to ``checked``, the full report."""
    named = lambda x: ", ".join(f"{_simple(f'{x}.denominazione_{level}')} AS {level}" for level in quality.LEVELS)
    out = (
        _WITH_DQ + f", areas AS ({_DQ_AREAS.format(comuni='comuni', boxes=duck('boxes'))}), c AS (SELECT id, {_simple('nazione')} AS nazione, {_simple('regione')} AS regione, {_simple('provincia')} AS provincia, comune, latitudine, longitudine FROM rows), "
        f"italy AS (SELECT nazione AS it FROM c WHERE nazione IN {_IT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), mr AS (SELECT regione, {_simple('match_key')} AS fr FROM ({match_sql('regione', 'c', 'regione')})), "
        f"mp AS (SELECT provincia, {_simple('match_key')} AS fp, {_simple('(SELECT min(denominazione_regione) FROM comuni WHERE denominazione_provincia = match_key)')} AS up FROM ({match_sql('provincia', 'c', 'provincia')})), "
        "t AS (SELECT c.*, mr.fr, mp.fp, mp.up, coalesce(mp.fp, c.provincia) AS told FROM c LEFT JOIN mr ON c.regione IS NOT DISTINCT FROM mr.regione LEFT JOIN mp ON c.provincia IS NOT DISTINCT FROM mp.provincia), "
        f"mc AS (SELECT x.comune AS asked, x.told, {named('n')} FROM ({match_sql('comune', 't', 'comune', parent='told')}) x JOIN comuni n ON x.codice_comune = n.codice_comune), kc AS (SELECT x0, y0, x1, y1, {named('areas')} FROM areas), "
        f"s0 AS (SELECT t.id, t.nazione, t.regione, t.provincia, {_simple('t.comune')} AS comune, t.latitudine, t.longitudine, italy.it, coalesce(t.nazione IN {_IT}, FALSE) AS is_in_italy, "
        f"{', '.join(f'FALSE AS {level}_check, CAST(NULL AS VARCHAR) AS {level}_suggestion' for level in ('nazione', *quality.LEVELS))}, FALSE AS coordinates_check, t.fr AS regione_from_regione, t.fp AS provincia_from_provincia, t.up AS regione_from_provincia, "
        f"{', '.join(f'mc.{level} AS {level}_from_comune, kc.{level} AS {level}_from_coordinates' for level in quality.LEVELS)} FROM t LEFT JOIN mc ON t.comune IS NOT DISTINCT FROM mc.asked AND t.told IS NOT DISTINCT FROM mc.told "
        "LEFT JOIN kc ON t.longitudine > kc.x0 AND t.longitudine < kc.x1 AND t.latitudine > kc.y0 AND t.latitudine < kc.y1, italy)"
    )
    steps = _dq_steps()
    for i, (where, values) in enumerate(steps):
        replaced = ", ".join(f"CASE WHEN coalesce({where}, FALSE) THEN {v} ELSE {k} END AS {k}" for k, v in values.items())
        out += f", s{i + 1} AS (SELECT * REPLACE ({replaced}) FROM s{i})"
    flags = [(f"{level}_check", f"{level}_suggestion") for level in ("nazione", *quality.LEVELS)] + [("coordinates_check", None)]
    return out + f", checked AS (SELECT * EXCLUDE (it), {_solved(flags)} FROM s{len(steps)}) "


@query(_dq_full() + "SELECT * FROM checked")
def dq_check(spark, d):
    return _dq(spark, d, _DQ_COLUMNS)


def _dq_share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round_even({a} / CAST({b} AS DOUBLE) * 100, 1) END"


_DQ_FIELDS = " UNION ALL ".join(
    f"SELECT '{field}' AS field, count(*) AS n_rows, count(*) FILTER (WHERE {problem}) AS n_problems, {solved} AS n_solved FROM checked"
    for field, problem, solved in [("*", '"check"', "count(*) FILTER (WHERE solved)"), *((x, f"{x}_check", f"count({x}_suggestion)") for x in ("nazione", *quality.LEVELS)), ("coordinates", "coordinates_check", "0")]
)


@query(_dq_full() + f"SELECT field, n_rows, n_problems, CAST(n_solved AS BIGINT) AS n_solved, {_dq_share('n_problems', 'n_rows')} AS problem_share, {_dq_share('n_solved', 'n_problems')} AS solved_share FROM ({_DQ_FIELDS})")
def dq_summary(spark, d):
    return quality.dq_summary(_dq(spark, d, _DQ_COLUMNS), _DQ_COLUMNS)
