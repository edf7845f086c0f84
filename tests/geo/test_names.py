import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from terrajobs.functions import text
from terrajobs.operators import matching, registry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_clean_name(spark):
    cases = {
        "Milano": "milano", "  L'Aquila!! ": "l aquila", "Forlì-Cesena": "forli cesena", "Paternò": "paternò", "Paterno": "paterno", "Paterno Paterno": "paterno",
        "": None, None: None, "Ünïcode ½ ﬁ": "unicode 12 fi", "a_b": "a_b", "Valle d'Aosta": "valle d aosta",
    }
    assert dict(zip(cases, many(spark, cases, text.clean_name))) == cases


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x17F), min_size=1, max_size=20), min_size=20, max_size=40))
def test_accents_go_as_nfkd_says(spark, texts):
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert many(spark, texts, text.to_ascii) == want


def test_prefixes_aliases_and_loose_keys(spark):
    assert one(spark, "comune di treviglio", lambda c: text.strip_area_prefix(c, "comune")) == "treviglio"
    assert one(spark, "citta metropolitana di torino", lambda c: text.strip_area_prefix(c, "provincia")) == "torino"
    assert many(spark, ["florence", "south tyrol", "x"], text.english_to_italian) == ["firenze", "bolzano", "x"]
    a, b = many(spark, ["san pietro di ba", "santo pietro ba"], text.loose_key)
    assert a == b


def test_human_format(spark):
    values = [0.0, 1.0, 12.0, 123.0, 1234.0, 99999.0, 1.5e6, 2.34e9, 7.77e12, 0.5, -1234.0]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", text.human_format(F.col("v")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows] == ["0", "1", "12", "120", "1.2K", "100K", "1.5M", "2.3B", "7.8T", "0.5", "-1.2K"]


def test_identifier_kind(spark):
    df = spark.createDataFrame([("1", "MI", "Milano", 3, None)] * 2 + [("002", "to", "Roma", 4, None)], "a string, b string, c string, d int, e string")
    assert [text.identifier_kind(df, c) for c in "abcde"] == ["code", "sigla", "name", "code", "name"]
    assert matching.key_column_for("code", "comune") == "codice_comune" and matching.key_column_for("sigla", "provincia") == "sigla"
    for bad in (("sigla", "comune"), ("other", "comune"), ("name", "stato")):
        with pytest.raises(ValueError):
            matching.key_column_for(*bad)


REGISTRY = [
    ("Milano", "Milano", "MI", "Lombardia"), ("Firenze", "Firenze", "FI", "Toscana"), ("Alto Reno Terme", "Bologna", "BO", "Emilia-Romagna"), ("Baranzate", "Milano", "MI", "Lombardia"),
    ("Treviglio", "Bergamo", "BG", "Lombardia"), ("Livo", "Como", "CO", "Lombardia"), ("Livo", "Trento", "TN", "Trentino-Alto Adige"), ("Roma", "Roma", "RM", "Lazio"), ("Ardea", "Roma", "RM", "Lazio"),
]


@pytest.fixture(scope="module")
def comuni(spark):
    rows = [(*r, i + 1) for i, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "denominazione_comune string, denominazione_provincia string, sigla string, denominazione_regione string, codice_comune int")


def test_dirty_names(spark, comuni):
    """The worked examples: exact, English, history, prefix, unmatched and null."""
    changes = spark.createDataFrame([("Porretta Terme", "Alto Reno Terme", "2016-01-01")], "denominazione_comune string, new_denominazione_comune string, data_decorrenza string")
    names = ["Milano", "florence", "porretta terme", "Baranzate", "comune di treviglio", "xxxx", None]
    df = spark.createDataFrame([(n,) for n in names], "citta string")
    mapping = matching.match_by_name(df, "citta", comuni, "comune", history=registry.historic_name_map(changes))
    got = {r["citta"]: r["match_key"] for r in mapping.collect()}
    assert got == dict(zip(names, ["Milano", "Firenze", "Alto Reno Terme", "Baranzate", "Treviglio", None, None]))
    assert [r[0] for r in matching.not_matched(mapping, "citta").collect()] == ["xxxx"]
    out = matching.enrich_result(df, mapping, comuni, ["citta"], "denominazione_comune")
    assert out.count() == len(names) and out.where("citta IS NULL AND sigla IS NULL").count() == 1


def test_homonyms_by_parent(spark, comuni):
    df = spark.createDataFrame([("Livo", "Como"), ("livo", "Trento"), ("Livo", None)], "citta string, prov string")
    got = {(r["citta"], r["prov"]): r["match_key"] for r in matching.match_by_name(df, "citta", comuni, "comune", parent="prov").collect()}
    assert got == {("Livo", "Como"): "Livo como", ("livo", "Trento"): "Livo", ("Livo", None): "Livo"}


def test_history_picks_the_earliest_and_null_first(spark):
    rows = [("a", "late", "2010-01-01"), ("a", "early", "1990-01-01"), ("b", "dated", "1990-01-01"), ("b", "undated", None), ("c", None, "1980-01-01")]
    changes = spark.createDataFrame(rows, "denominazione_comune string, new_denominazione_comune string, data_decorrenza string")
    assert {r["old_name"]: r["new_name"] for r in registry.historic_name_map(changes).collect()} == {"a": "early", "b": "undated"}


def test_enrich_modes_and_clashes(spark, comuni):
    df = spark.createDataFrame([("Milano", "x"), ("xxxx", "y"), (None, "z")], "citta string, sigla string")
    mapping = matching.match_by_name(df, "citta", comuni, "comune")
    count = lambda **k: matching.enrich_result(df, mapping, comuni, ["citta"], "denominazione_comune", **k).count()
    n = len(REGISTRY)
    assert (count(), count(drop_not_match=True), count(add_missing=True), count(add_missing=True, drop_not_match=True)) == (3, 1, n + 2, n)
    assert "sigla_new" in matching.enrich_result(df, mapping, comuni, ["citta"], "denominazione_comune").columns


def test_manual_lookup_and_codes(spark, comuni):
    df = spark.createDataFrame([("Milanoa", "001"), ("Roma", "8"), ("zz", "n")], "citta string, code string")
    mapping = matching.manual_match(matching.match_by_name(df, "citta", comuni, "comune"), "citta", {"Milanoa": "Milano"})
    assert {r["citta"]: r["match_key"] for r in mapping.collect()} == {"Milanoa": "Milano", "Roma": "Roma", "zz": None}
    assert {r["code"]: r["match_key"] for r in matching.match_by_code(df, "code", comuni, "comune").collect()} == {"001": 1, "8": 8, "n": None}
    assert matching.lookup_one(spark, "rome", comuni, "comune")["sigla"] == "RM"
    with pytest.raises(KeyError):
        matching.lookup_one(spark, "nowhere", comuni, "comune")


def test_localities(spark, comuni):
    asked = spark.createDataFrame([("marina di ardea",), ("nulla",)], "citta string")
    gazetteer = spark.createDataFrame([("Marina di Ardea", "Marina di Ardea, Ardea, Roma Capitale, Lazio, 00040, Italia", 0), ("nulla", "Nulla, Nowhere, Bologna, Emilia-Romagna, Italia", 0)], "name string, address string, rank int")
    assert [tuple(r) for r in matching.match_localities(asked, "citta", gazetteer, comuni).collect()] == [("marina di ardea", "ardea")]
    pages = spark.createDataFrame([("<p>Marina di Ardea si trova nel comune di Ardea in provincia di Roma. Nulla si trova nel comune di Roma. Nulla si trova nel comune di Milano.</p>",)], "html string")
    assert [tuple(r) for r in matching.match_localities_from_pages(asked, "citta", pages, comuni).collect()] == [("marina di ardea", "ardea")]


def test_similarity_against_brute_force(spark):
    from difflib import SequenceMatcher, get_close_matches

    words = ["milanoo", "frienze", "romaa", "trevigli", "xxxxxxxx", "baranzat", "milano", "firenz", "aaaa", "abcd"]
    known = [r[0].lower() for r in REGISTRY] + ["milan", "romana", "rom", "dcba", "aaab"]
    want = {}
    for w in words:
        ranked = sorted(((SequenceMatcher(None, c, w).ratio(), c) for c in set(known)), reverse=True)
        assert get_close_matches(w, known, 1, 0.6)[:1] == [c for r, c in ranked[:1] if r >= 0.6]
        best = ranked[0][1] if ranked[0][0] >= 0.6 else None
        if best and SequenceMatcher(None, w, best).ratio() > 0.85:
            want[w] = best
    df, reg = spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(k,) for k in known], "k string")
    assert {r["word"]: r["match"] for r in matching.match_by_similarity(df, "w", reg, "k").collect()} == want
    unique = matching.match_by_similarity(df, "w", reg, "k", unique=True).collect()
    assert len({r["match"] for r in unique}) == len(unique) and {r["word"] for r in unique} <= set(want)


def test_empty_inputs(spark, comuni):
    none = spark.createDataFrame([], "citta string")
    mapping = matching.match_by_name(none, "citta", comuni, "comune")
    out = matching.enrich_result(none, mapping, comuni, ["citta"], "denominazione_comune")
    assert out.count() == 0 and set(comuni.columns) <= set(out.columns)


def test_homonyms_keep_their_rows(spark, comuni):
    """Both Livos, by province, region, sigla and code; each row comes once, with its own area; by hand too."""
    rows = [(1, "Livo", "Como"), (2, "livo", "Trento"), (3, "Livo", None), (4, "Milano", "Milano"), (5, None, None), (6, "zz", "Como")]
    df = spark.createDataFrame(rows, "id int, citta string, prov string")
    mapping = matching.match_by_name(df, "citta", comuni, "comune", parent="prov")
    out = matching.enrich_result(df, mapping, comuni, ["citta", "prov"], "denominazione_comune")
    assert {r["id"]: r["codice_comune"] for r in out.collect()} == {1: 6, 2: 7, 3: 7, 4: 1, 5: None, 6: None} and out.count() == len(rows)
    assert {r["denominazione_comune"] for r in out.where("id < 4").collect()} == {"Livo"}
    known = comuni.withColumns({"codice_provincia": F.when(F.col("sigla") == "CO", 13).when(F.col("sigla") == "TN", 22), "codice_regione": F.when(F.col("denominazione_regione") == "Lombardia", 3).otherwise(4)})
    for kind, up in {"regione": ("Lombardia", "Trentino-Alto Adige"), "sigla": ("CO", "tn"), "codice_provincia": ("013", "22"), "codice_regione": ("3", "04")}.items():
        asked = spark.createDataFrame([("Livo", up[0]), ("Livo", up[1])], "citta string, p string")
        got = {r["p"]: r["codice_comune"] for r in matching.match_by_name(asked, "citta", known, "comune", parent="p", parent_kind=kind).collect()}
        assert got == {up[0]: 6, up[1]: 7}, kind
    with pytest.raises(ValueError):
        matching.match_by_name(df, "citta", comuni, "comune", parent="prov", parent_kind="x")
    by_hand = matching.manual_match(matching.match_by_name(df, "citta", comuni, "comune"), "citta", {"zz": "Livo como"})
    named = matching.enrich_result(df, by_hand, comuni, ["citta"], "denominazione_comune")
    assert {r["id"]: r["codice_comune"] for r in named.collect()} == {1: 7, 2: 7, 3: 7, 4: 1, 5: None, 6: 6}
    assert matching.lookup_area(df, "citta", comuni, "comune", parent="prov").count() == 4


def test_clashing_columns_and_repeated_results(spark, comuni):
    """Columns named as the job's own, and a job applied to its own result."""
    names = ("match_key", "_match", "codice_comune", "_key0", "_area0", "denominazione_comune", "codice_comune_new", "SIGLA")
    df = spark.createDataFrame([("Milano", *range(8)), (None, *range(8))], "citta string, " + ", ".join(f"{n} int" for n in names))
    mapping = matching.match_by_name(df, "citta", comuni, "comune")
    once = matching.enrich_result(df, mapping, comuni, ["citta"], "denominazione_comune")
    twice = matching.enrich_result(once, mapping, comuni, ["citta"], "denominazione_comune")
    assert twice.count() == 2 and len({c.lower() for c in twice.columns}) == len(twice.columns)
    row = twice.where("citta IS NOT NULL").first()
    assert [row[n] for n in names] == list(range(8)) and row["codice_comune_new_new"] == row["codice_comune_new_new_new"] == 1


def test_pages_of_long_names_and_parents(spark):
    long_comune, long_place = "San Giovanni di Sopra alla Valle Grande Bassa", "Contrada Alta dei Sette Pini Vecchi del Monte"
    rows = [(long_comune, "Como", 1), ("Livo", "Como", 2), ("Livo", "Trento", 3), ("Roma", "Roma", 4), ("Forlì", "Forlì-Cesena", 5)]
    comuni = spark.createDataFrame(rows, "denominazione_comune string, denominazione_provincia string, codice_comune int").withColumn("denominazione_regione", F.lit("R"))
    padding = "una lunga storia di questo posto tra i monti e le valli che nessuno ha mai raccontato prima d'ora per intero " * 2
    pages = spark.createDataFrame([
        (f"<p>{padding}{long_place} si trova nel comune di {long_comune} da secoli.</p>",), ("<p>Pieve fa parte del comune di Livo. Torre, frazione (piccola) del comune di Forlì e altro.</p>",),
        ("<p>Duo si trova nel comune di Livo e Trio fa parte del comune di Roma.</p>",), (f"<p>Lontano {'x' * 41} si trova nel comune di Roma. Vicino {'x' * 30} si trova nel comune di Roma</p>",),
        ("<p>Prato è una località del comune di Roma</p>",), (None,),
    ], "html string")
    asked = spark.createDataFrame([(n, p) for n in (long_place, "Pieve", "Torre", "Duo", "Trio", "Lontano", "Vicino", "Prato", None, "") for p in (None, "Provincia di Trento")], "n string, p string")
    got = {r["n"]: r["comune"] for r in matching.match_localities_from_pages(asked, "n", pages, comuni).collect()}
    assert got == {long_place: "san giovanni di sopra alla valle grande bassa", "Pieve": "livo", "Torre": "forli", "Duo": "livo", "Trio": "roma", "Vicino": "roma", "Prato": "roma"}
    held = {(r["n"], r["p"]): r["comune"] for r in matching.match_localities_from_pages(asked, "n", pages, comuni, parent="p").collect()}
    assert held == {("Pieve", "Provincia di Trento"): "livo", ("Duo", "Provincia di Trento"): "livo"}
    full = {(r["n"], r["p"]): r["codice_comune"] for r in matching.match_areas(asked.where("p IS NOT NULL"), "n", comuni, "comune", parent="p", pages=pages).collect()}
    assert full["Pieve", "Provincia di Trento"] == 3 and full["Trio", "Provincia di Trento"] is None
    assert matching.match_localities_from_pages(asked.limit(0), "n", pages, comuni).count() == 0


def test_similarity_by_rare_letters_loses_nothing(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(8)
    known = sorted({"".join(rng.choices("abcdeio", k=rng.randint(3, 9))) for _ in range(150)})
    words = sorted({"".join(c for c in w if rng.random() > 0.12) + rng.choice(["", "a", "x"]) for w in known for _ in range(2)} - {""})
    want = {}
    for w in words:
        score, best = max((SequenceMatcher(None, c, w).ratio(), c) for c in known)
        if score >= 0.6 and SequenceMatcher(None, w, best).ratio() > 0.85:
            want[w] = best
    df, reg = spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(k,) for k in known], "k string")
    assert len(want) > 50 and {r["word"]: r["match"] for r in matching.match_by_similarity(df, "w", reg, "k").collect()} == want
    chain = matching.match_by_similarity(df, "w", reg, "k", unique=True).collect()
    taken, free, left = {}, set(known), {(w, c): SequenceMatcher(None, w, c).ratio() for w in words for c in known if SequenceMatcher(None, c, w).ratio() >= 0.6}
    pairs = {k: r for k, r in left.items() if r > 0.85}
    while pairs:
        by_word, by_name = {}, {}
        for (w, c), r in pairs.items():
            by_word[w] = max(by_word.get(w, (-1, "")), (r, c))
            by_name[c] = min(by_name.get(c, (1, "")), (-r, w))
        mutual = {w: c for w, (_, c) in by_word.items() if by_name[c][1] == w}
        taken |= mutual
        free -= set(mutual.values())
        pairs = {(w, c): r for (w, c), r in pairs.items() if w not in taken and c in free}
    assert {r["word"]: r["match"] for r in chain} == taken


def test_words_of_the_same_letters_do_not_all_meet(spark):
    """The reviewed case: names of few syllables, whose rarest letters nearly all others have too."""
    from difflib import SequenceMatcher

    made = lambda i: "borgo " + "".join(("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru")[int(d)] for d in f"{i:04d}")
    known = [made(i) for i in range(0, 9000, 3)]
    words = [w[:8] + w[9:] if i % 2 else w[:9] + w[10] + w[9] + w[11:] for i, w in enumerate(known)]
    df, reg = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "name string")
    pairs = {tuple(r) for r in matching.similarity_candidates(df, "word", reg, "name", 0.92).collect()}
    assert len(pairs) < 20 * len(words)
    for w in words[::150]:
        assert {k for k in known if SequenceMatcher(None, k, w).ratio() >= 0.92} <= {k for x, k in pairs if x == w}
    got = {r["word"]: (r["match"], r["ratio"]) for r in matching.match_by_similarity(df, "word", reg, "name").collect()}
    for w in words[::150]:
        score, best = max((SequenceMatcher(None, k, w).ratio(), k) for k in known)
        assert got[w] == (best, SequenceMatcher(None, w, best).ratio())


def test_long_words_meet_under_letters(spark):
    from difflib import SequenceMatcher

    known = ["san giovanni in persiceto di sopra", "castelnuovo di garfagnana alta", "santa maria della versa e monti"]
    words = ["san giovani in persiceto di sopr", "castelnovo garfagnana alta", "santa mara versa e monti", "san giovanni"]
    df, reg = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "name string")
    for least in (0.6, 0.85, 0.92):
        pairs = [tuple(r) for r in matching.similarity_candidates(df, "word", reg, "name", least).collect()]
        assert len(set(pairs)) == len(pairs) and {(w, k) for w in words for k in known if SequenceMatcher(None, k, w).ratio() >= least} <= set(pairs)


def test_one_to_one_takes_the_same_at_any_steps(spark, monkeypatch):
    """Pairs of a step come before all others, and what they take is out: one step gives what two give."""
    known = ["borgo bace", "borgo bale", "borgo bade", "castel dido", "castel dodi", "villa gula", "villa gulu", "monte"]
    words = ["borgo bac", "borgo bacee", "borgo blae", "castel ddo", "castel dodo", "villa gulla", "vila gula", "mont", "xxx"]
    df, reg = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "name string")
    two = {tuple(r) for r in matching.match_by_similarity(df, "word", reg, "name", unique=True).collect()}
    monkeypatch.setattr(matching, "STEPS", (matching.MATCH_RATIO,))
    assert two and two == {tuple(r) for r in matching.match_by_similarity(df, "word", reg, "name", unique=True).collect()}


def test_few_bytes_of_names_are_not_one_task(spark, monkeypatch):
    """Names weigh little and ask for much: each step in Python is dealt over all partitions, whatever Spark thinks of the bytes."""
    words, known = [f"borgo {i:03d}" for i in range(200)], [f"borgo {i:03d}x" for i in range(200)]
    df, reg = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "name string")
    monkeypatch.setattr(matching, "_ratio", lambda a, b: 1 + F.spark_partition_id().cast("double"))
    assert matching._scored(df, reg, 0.92).select("score").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
