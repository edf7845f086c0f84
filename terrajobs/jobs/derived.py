"""Geographic tables derived from the star-schema tables, by SQL that Spark and DuckDB both run.

A supplier stands for a comune, a nation for a province, a region for a region; customers carry dirty names of places and
points; line items are a population grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_SYLLABLES = ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru")


def _word(x: str) -> str:
    out = f"CAST({x} AS STRING)"
    for digit, syllable in enumerate(_SYLLABLES):
        out = f"replace({out}, '{digit}', '{syllable}')"
    return out


def comune_full(x: str) -> str:
    return (
        f"CASE {x} WHEN 0 THEN 'Roma' WHEN 1 THEN 'Milano' WHEN 2 THEN 'Firenze' WHEN 3 THEN 'Paternò' WHEN 4 THEN 'Livo' WHEN 5 THEN 'Livo' WHEN 6 THEN 'Forlì' "
        f"WHEN 7 THEN 'Merano/Meran' WHEN 8 THEN 'Sant Angelo di Ba' ELSE CASE {x} % 5 WHEN 0 THEN 'Borgo ' WHEN 1 THEN 'Castel ' WHEN 2 THEN 'San ' WHEN 3 THEN 'Monte ' ELSE 'Villa ' END || {_word(x)} END"
    )


def comune(x: str) -> str:
    return f"CASE {x} WHEN 7 THEN 'Merano' ELSE {comune_full(x)} END"


def provincia_full(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'Como' WHEN 1 THEN 'Trento' WHEN 2 THEN 'Napoli' WHEN 3 THEN 'Bolzano/Bozen' WHEN 4 THEN 'Sud Sardegna' ELSE 'Pro' || {_word(x)} END"


def regione_full(x: str) -> str:
    return (
        f"CASE {x} WHEN 0 THEN 'Lombardia' WHEN 1 THEN 'Trentino-Alto Adige/Südtirol' WHEN 2 THEN 'Campania' WHEN 3 THEN 'Sicilia' "
        "ELSE 'Valle d''Aosta/Vallée d''Aoste' END"
    )


_PLACED = "SELECT s_suppkey AS k, s_acctbal AS bal, CASE s_suppkey WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE s_nationkey END AS nk FROM {supplier}"
_SIGLA = "CASE n_nationkey WHEN 0 THEN 'CO' WHEN 1 THEN 'TN' WHEN 2 THEN NULL WHEN 3 THEN 'BZ' WHEN 4 THEN 'SU' ELSE 'X' || chr(65 + n_nationkey) END"
_GEO_AREA = "CASE WHEN n_regionkey < 2 THEN 'Nord' WHEN n_regionkey = 2 THEN 'Sud' ELSE 'Isole' END"

SQL = {
    # As the registry file has it: text codes, bilingual names, no sigla for Napoli.
    "registry_raw": f"""
        SELECT lpad(CAST(k + 1 AS STRING), 6, '0') AS codice_comune, {comune('k')} AS denominazione_comune, {comune_full('k')} AS denominazione_comune_ita_straniera,
               lpad(CAST(n_nationkey + 1 AS STRING), 3, '0') AS codice_provincia, {provincia_full('n_nationkey')} AS denominazione_provincia,
               lpad(CAST(n_regionkey + 1 AS STRING), 2, '0') AS codice_regione, {regione_full('n_regionkey')} AS denominazione_regione,
               {_SIGLA} AS sigla, {_GEO_AREA} AS area_geografica
        FROM ({_PLACED}) s JOIN {{nation}} ON nk = n_nationkey""",
    "population": "SELECT CAST(s_suppkey + 1 AS INT) AS codice_comune, CAST(floor(abs(s_acctbal) * 10) AS BIGINT) AS popolazione FROM {supplier} WHERE s_suppkey % 13 <> 12",
    "area": "SELECT CAST(s_suppkey + 1 AS INT) AS codice_comune, CAST(s_suppkey % 97 + 0.5E0 AS DOUBLE) AS superficie_km2 FROM {supplier}",
    "changes": """
        SELECT 'Vecchio ' || CAST(o_custkey % 40 AS STRING) AS denominazione_comune, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Nuovo-' || CAST(o_orderkey % 90 AS STRING) END AS new_denominazione_comune,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS data_decorrenza, CASE o_orderstatus WHEN 'F' THEN 'ES' WHEN 'O' THEN 'CD' ELSE 'AP' END AS tipo_variazione,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'nome accanto alla denominazione in lingua italiana' ELSE 'testo' END AS contenuto, o_orderkey
        FROM {orders}""",
    "dirty": f"""
        SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS valore,
               CASE c_custkey % 9 WHEN 0 THEN nome WHEN 1 THEN 'Comune di ' || nome WHEN 2 THEN upper(nome) WHEN 3 THEN '  ' || nome || '!!' WHEN 4 THEN CASE nome WHEN 'Roma' THEN 'Rome' WHEN 'Milano' THEN 'Milan' WHEN 'Firenze' THEN 'florence' ELSE lower(nome) END
                    WHEN 5 THEN replace(nome, 'o', 'ò') WHEN 6 THEN 'frazione ' || replace(nome, ' ', '-') WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN 'xxxx' ELSE NULL END ELSE replace(nome, 'San ', 'Santa ') END AS citta,
               CASE c_custkey % 4 WHEN 0 THEN lower(sg) WHEN 1 THEN sg WHEN 2 THEN NULL ELSE 'zz' END AS sg,
               CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 30 AS STRING) WHEN 1 THEN lpad(CAST(c_custkey % 30 AS STRING), 3, '0') ELSE 'n' END AS codice,
               CASE c_custkey % 3 WHEN 0 THEN prov WHEN 1 THEN 'Provincia di ' || prov ELSE upper(prov) END AS prov,
               CASE c_custkey % 3 WHEN 0 THEN reg WHEN 1 THEN upper(reg) ELSE CASE reg WHEN 'Lombardia' THEN 'Lombardy' WHEN 'Sicilia' THEN 'Sicily' ELSE reg END END AS reg
        FROM (SELECT c_custkey, c_acctbal, {comune('(c_custkey % 120)')} AS nome, CASE c_nationkey WHEN 0 THEN 'CO' WHEN 1 THEN 'TN' WHEN 3 THEN 'BZ' ELSE 'X' || chr(65 + c_nationkey) END AS sg,
                     CASE c_nationkey WHEN 3 THEN 'Bolzano' ELSE {provincia_full('c_nationkey')} END AS prov,
                     CASE c_custkey % 4 WHEN 0 THEN 'Lombardia' WHEN 1 THEN 'Campania' WHEN 2 THEN 'Sicilia' ELSE 'Altrove' END AS reg FROM {{customer}}) d""",
    # Points over the country's box, nearly all in general position; every 50th without latitude.
    "points": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE CAST(36E0 + ((c_custkey * 7919) % 11000) / 1024E0 + 0.00037E0 AS DOUBLE) END AS lat,
               CAST(6.5E0 + ((c_custkey * 104729) % 12000) / 1024E0 + 0.00041E0 AS DOUBLE) AS lon, CAST(round(c_acctbal * 100) AS BIGINT) AS valore, c_mktsegment AS segmento FROM {customer}""",
    "grid": """
        SELECT CAST(6.5E0 + ((l_orderkey * 104729 + l_linenumber * 17) % 12000) / 1024E0 AS DOUBLE) AS Lon, CAST(36E0 + ((l_orderkey * 7919 + l_linenumber * 31) % 11000) / 1024E0 AS DOUBLE) AS Lat,
               CAST(l_quantity AS DOUBLE) AS Population FROM {lineitem}""",
    # Nations as boxes of a 5 by 5 lattice.
    "boxes": f"""
        SELECT CASE WHEN n_nationkey = 3 THEN 'Bolzano' ELSE {provincia_full('n_nationkey')} END AS denominazione_provincia, {regione_full('n_regionkey')} AS denominazione_regione, n_nationkey AS codice,
               CAST(6.5E0 + (n_nationkey % 5) * 2.5E0 AS DOUBLE) AS x0, CAST(36E0 + CAST(floor(n_nationkey / 5) AS INT) * 2.25E0 AS DOUBLE) AS y0,
               CAST(6.5E0 + (n_nationkey % 5) * 2.5E0 + 2.5E0 AS DOUBLE) AS x1, CAST(36E0 + CAST(floor(n_nationkey / 5) AS INT) * 2.25E0 + 2.25E0 AS DOUBLE) AS y1 FROM {{nation}}""",
    # The boxes, every second one as two halves above each other: borders meet in a T.
    "halves": f"""
        SELECT denominazione_regione, codice, h AS half, x0, x1, CASE h WHEN 2 THEN ym ELSE y0 END AS y0, CASE h WHEN 1 THEN ym ELSE y1 END AS y1 FROM (
          SELECT {regione_full('n_regionkey')} AS denominazione_regione, n_nationkey AS codice, CAST(6.5E0 + (n_nationkey % 5) * 2.5E0 AS DOUBLE) AS x0, CAST(6.5E0 + (n_nationkey % 5) * 2.5E0 + 2.5E0 AS DOUBLE) AS x1,
                 CAST(36E0 + CAST(floor(n_nationkey / 5) AS INT) * 2.25E0 AS DOUBLE) AS y0, CAST(36E0 + CAST(floor(n_nationkey / 5) AS INT) * 2.25E0 + 1E0 AS DOUBLE) AS ym, CAST(36E0 + CAST(floor(n_nationkey / 5) AS INT) * 2.25E0 + 2.25E0 AS DOUBLE) AS y1 FROM {{nation}}) b
        JOIN (SELECT 0 AS h UNION ALL SELECT 1 UNION ALL SELECT 2) t ON CASE WHEN codice % 2 = 0 THEN h = 0 ELSE h > 0 END""",
    "exits": """
        SELECT s_suppkey AS id, 'Uscita' AS name, CAST(6.5E0 + ((s_suppkey * 15485863) % 11987) / 1024E0 AS DOUBLE) AS x, CAST(36E0 + ((s_suppkey * 32452843) % 10973) / 1024E0 AS DOUBLE) AS y,
               CASE WHEN s_suppkey % 4 = 0 THEN 'Superstrada' ELSE 'Autostrada' END AS classificazione FROM {supplier}""",
    # A road for each order, from one derived point to another; the billionths keep roads off each other's beginnings.
    "roads": """
        SELECT o_orderkey AS k, CAST(6.5E0 + ((o_orderkey * 7907) % 12000) / 1024E0 + o_orderkey * 1E-9 AS DOUBLE) AS x1, CAST(36E0 + ((o_orderkey * 7883) % 11000) / 1024E0 AS DOUBLE) AS y1,
               CAST(6.5E0 + ((o_orderkey * 7907) % 12000) / 1024E0 + o_orderkey * 1E-9 + 0.05E0 AS DOUBLE) AS x2, CAST(36E0 + ((o_orderkey * 7883) % 11000) / 1024E0 + 0.03E0 AS DOUBLE) AS y2,
               CASE o_orderkey % 5 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'trunk' ELSE 'motorway' END AS type,
               CASE o_orderkey % 6 WHEN 0 THEN 'A ' || CAST(o_orderkey % 9 AS STRING) WHEN 1 THEN 'RA' || CAST(o_orderkey % 9 AS STRING) || 'dir' WHEN 2 THEN 'GRA' WHEN 3 THEN NULL WHEN 4 THEN 'A21racc' ELSE 'SS' || CAST(o_orderkey % 9 AS STRING) END AS ref,
               CASE WHEN o_orderkey % 12 = 3 THEN 'E 80' ELSE NULL END AS int_ref, CASE WHEN o_orderkey % 10 = 9 THEN 'Diramazione A21' ELSE 'Strada' END AS nome
        FROM {orders}""",
    "addresses": f"""
        SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN 'xxxx' WHEN 4 THEN 'Via dellAquila ' || w ELSE 'Via ' || w END AS address,
               CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE {comune('(c_custkey % 20)')} END AS citta
        FROM (SELECT c_custkey, {_word('c_custkey % 50')} AS w FROM {{customer}}) a""",
    # Addresses of the gazetteer in other words: with a postcode, an abbreviated road, another order, a word too many or too few.
    "variants": f"""
        SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Via ' || w || ' - 20121' WHEN 1 THEN 'V. ' || w WHEN 2 THEN w || ', Via' WHEN 3 THEN 'Via Vecchia ' || w WHEN 4 THEN w ELSE 'Via xxxx' END AS address,
               CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE {comune('(c_custkey % 20)')} END AS citta
        FROM (SELECT c_custkey, {_word('c_custkey % 50')} AS w FROM {{customer}}) a""",
    "gazetteer": f"""
        SELECT address, full_address, city, latitude, longitude FROM (
          SELECT CASE WHEN p_partkey % 2 = 0 THEN 'via ' || {_word('(p_partkey % 50)')} ELSE 'via dell''aquila ' || {_word('(p_partkey % 50)')} END || ', ' || lower({comune('(p_partkey % 20)')}) AS address,
                 'Via ' || {_word('(p_partkey % 50)')} || ', ' || {comune('(p_partkey % 20)')} || ', Italia' AS full_address, {comune('(p_partkey % 20)')} AS city,
                 CAST(36E0 + ((p_partkey * 7919) % 11000) / 1024E0 AS DOUBLE) AS latitude, CAST(6.5E0 + ((p_partkey * 104729) % 12000) / 1024E0 AS DOUBLE) AS longitude FROM {{part}}) g""",
    # Localities with the address that says where they are; some addresses are of no use.
    "localities": f"""
        SELECT 'Localita ' || {_word('p_partkey')} AS name, CAST(p_partkey % 5 AS INT) AS rank,
               CASE p_partkey % 4 WHEN 0 THEN 'Localita ' || {_word('p_partkey')} || ', ' || {comune('(p_partkey % 10 + 9)')} || ', Como, Lombardia, 22100, Italia'
                    WHEN 1 THEN 'Localita ' || {_word('p_partkey')} || ', ' || {comune('(p_partkey % 10 + 9)')} || ', Napoli, Campania, Italia'
                    WHEN 2 THEN 'Localita ' || {_word('p_partkey')} || ', Nowhere, Como, Lombardia, Italia' ELSE 'Localita ' || {_word('p_partkey')} END AS address FROM {{part}}""",
    "said": f"""
        SELECT doc_id, 'p. il luogo posto ' || {_word('(doc_id % 60)')} || ' si trova nel comune di ' || CASE WHEN doc_id % 60 < 30 THEN lower({comune('(doc_id % 60 + 10)')}) ELSE lower({comune('(doc_id % 23 + 9)')}) END || ' in italia. fine' AS text
        FROM {{documents}}""",
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables of ``sf_dir``."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def duck(name: str) -> str:
    """The same as a DuckDB subquery."""
    return "(" + SQL[name].format(**{t: t for t in TABLES}) + ")"
