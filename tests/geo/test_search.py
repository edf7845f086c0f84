"""Search by words, localities in addresses, and abbreviations by windows of words."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrajobs.functions import names
from terrajobs.operators import geocode, search


def words(text):
    return sorted(set(re.findall(r"\w+", text.lower())))


def brute(asked, entries, least):
    """Every text against every entry."""
    sets = {}
    for text, value in entries:
        if words(text):
            key = tuple(words(text))
            sets[key] = min(sets.get(key, value), value)
    n = Counter(w for s in sets for w in s)
    weight = {w: math.floor(search.UNIT * math.log(1 + len(sets) / k) + 0.5) for w, k in n.items()}
    out = {}
    for text in asked:
        own = [w for w in words(text or "") if w in weight]
        found = []
        for s, value in sets.items():
            both, total = sum(weight[w] for w in own if w in s), sum(map(weight.get, own)) + sum(map(weight.get, s))
            if both and 2 * both / total >= least:
                found.append((-2 * both / total, value))
        if found:
            score, value = min(found)
            out[text] = (value, -score)
    return out


def answers(spark, asked, entries, least):
    a, e = spark.createDataFrame([(t,) for t in asked], "t string"), spark.createDataFrame(entries, "address string, n int")
    return {r["t"]: (r["value"], r["score"]) for r in search.search(a, "t", e, "address", F.col("n"), least).collect()}


@pytest.mark.parametrize("least", [0.3, 0.7, 1.0])
def test_equals_all_pairs(spark, least):
    rng = random.Random(least)
    some = ["roma", "milano", "verdi", "dante", "garibaldi", "mazzini", "cavour", "10", "12", "marconi", "nuova", "vecchia"]
    text = lambda: " ".join(["via"] * (rng.random() < 0.9) + rng.choices(some, [9, 7, 3, 2, 2, 1, 1, 4, 4, 1, 1, 1], k=rng.randint(1, 4)))
    entries = [(text(), i) for i in range(150)] + [("Via", 900), ("", 901), (None, 902), ("via via", 903)]
    asked = [text() for _ in range(80)] + [None, "", "sconosciuta 999", "VIA", "Via Dante, 10 - 20121", "dante via 10", "verdì"]
    got, want = answers(spark, asked, [e for e in entries], least), brute(asked[:-1], [e for e in entries if e[0]], least)
    got.pop("verdì", None)
    assert got.keys() == want.keys() and all(got[t][0] == want[t][0] and got[t][1] == pytest.approx(want[t][1], abs=1e-12) for t in want)


def test_reviewed_addresses(spark):
    """A postcode, an abbreviated road and another order of words find the address; another street does not."""
    gazetteer = [("via roma 10, milano", "Via Roma 10, Milano, Italia", 45.0, 9.0), ("via roma 10, torino", "Via Roma 10, Torino, Italia", 45.1, 7.7), ("via verdi 3, milano", "Via Verdi 3, Milano, Italia", 45.2, 9.2)]
    gazetteer += [(f"via x{i} {i}, paese{i}", f"Via X{i}, Paese{i}", 40.0, 10.0) for i in range(40)]
    g = spark.createDataFrame(gazetteer, "address string, full_address string, latitude double, longitude double")
    asked = [("Via Roma 10 - 20121", "Milano"), ("V. Roma 10", "Milano"), ("10, Roma Via", "Torino"), ("Via Roma 10", "Milano"), ("Via Ignota 7", "Milano"), (None, "Milano"), ("Via Verdi 3", None)]
    df = spark.createDataFrame(asked, "address string, comune string")
    found = lambda **o: {r["address"]: r["latitude"] for r in geocode.geocode_addresses(df, g, "address", comune="comune", **o).collect()}
    assert found(similar=0.7) == {"Via Roma 10 - 20121": 45.0, "V. Roma 10": 45.0, "10, Roma Via": 45.1, "Via Roma 10": 45.0, "Via Ignota 7": None, None: None, "Via Verdi 3": None}
    assert {k: v for k, v in found().items() if v} == {"Via Roma 10": 45.0}
    with pytest.raises(ValueError):
        search.search(df, "address", g, "address", F.col("latitude"), 0)


def test_frequent_words_are_no_keys(spark):
    entries = spark.createDataFrame([(f"via nome{i} {i % 30}, roma", i) for i in range(600)], "address string, n int")
    sets = entries.select(search.text_words(F.col("address")).alias("words"))
    under = {r["word"] for r in search._filed(sets, search.word_weights(sets), "e", 0.7).select("word").distinct().collect()}
    assert not under & {"via", "roma"} and len(under) >= 600


def test_holders(spark):
    rows = [("Marina di Ardea, Ardea, Roma", 1), ("Ardea Marina, Roma", 2), ("Lido, Marina di Ardea, Roma", 3), ("Marinara di Ardea", 4), (None, 5), ("", 6)]
    entries, asked = spark.createDataFrame(rows, "address string, n int"), spark.createDataFrame([("marina di ardea",), ("Lido",), ("ardea sconosciuta",), (None,), ("",), ("ardea roma",)], "t string")
    got = Counter((r["t"], r["n"]) for r in search.holders(asked, "t", entries, "address").collect())
    assert got == Counter([("marina di ardea", 1), ("marina di ardea", 3), ("Lido", 3), ("ardea roma", 1), ("ardea roma", 3)])


def plain_windows(asked, pages):
    """Every start of every page against every address, as text."""
    said = {}
    for text in asked:
        parts = re.split(" +", (text or "").split(",")[0].strip())
        dotted = [i for i, w in enumerate(parts) if re.fullmatch(r"(?:[^\W\d_A-Z]\.)+", w)]
        if not dotted or dotted[0] == 0 or dotted != list(range(dotted[0], dotted[0] + len(dotted))) or dotted[-1] == len(parts) - 1:
            continue
        road, letters, name = parts[: dotted[0]], [c for i in dotted for c in parts[i] if c != "."], parts[dotted[-1] + 1 :]
        for page in pages:
            w = page.split(" ")
            for i in range(len(w) - len(road) - len(letters) - len(name) + 1):
                a, b, c = w[i : i + len(road)], w[i + len(road) : i + len(road) + len(letters)], w[i + len(road) + len(letters) : i + len(road) + len(letters) + len(name)]
                same_road = a == road or (" ".join(road) in names.ROAD_PREFIXES and a[0] in names.ROAD_PREFIXES)
                if same_road and c == name and all(re.fullmatch("[a-z]{2,}", x) and x[0] == y for x, y in zip(b, letters)):
                    said.setdefault(text, set()).add(" ".join(a + b + c))
    return {t: s.pop() for t, s in said.items() if len(s) == 1}


def test_abbreviations_by_windows(spark):
    asked = ["viale g. p. da palestrina, roma", "via g. verdi", "piazza g. verdi", "via g.p. da palestrina", "via g. roma", "g. verdi", "via verdi g.", "via g. x p. rossi", "strada m. rossi", None, "", "via m. nera"]
    pages = ["la via giovanni pierluigi da palestrina a roma", "in viale giuseppe verdi e piazza giuseppe verdi", "via giacomo roma oppure via giorgio roma", "via g verdi", "corso maria rossini", "largo mario rossi", "strada mario rossi", "via maria nera via maria nera"]
    a, p = spark.createDataFrame([(t,) for t in asked], "s string"), spark.createDataFrame([(t,) for t in [*pages, None, "", "via"]], "text string")
    got = {r["s"]: r["expanded"] for r in geocode.expand_abbreviations(a, "s", p, html=None).collect()}
    assert got == plain_windows(asked, pages) and got["viale g. p. da palestrina, roma"] == "via giovanni pierluigi da palestrina" and got["piazza g. verdi"] == "piazza giuseppe verdi"
    assert got["via m. nera"] == "via maria nera" and "via g. roma" not in got and "strada m. rossi" not in got
    assert geocode.expand_abbreviations(a.limit(0), "s", p, html=None).count() == 0


def test_a_word_on_every_page_grows_no_row(spark):
    """However many pages say a name, one row a key is left before addresses are met."""
    pages = spark.range(2000).select(F.concat(F.lit("via "), F.when(F.col("id") % 2 == 0, "anna").otherwise("aldo"), F.lit(" roma e via bruno roma")).alias("text"))
    asked = spark.createDataFrame([("via a. roma",), ("via b. roma",)] + [(f"via c. roma{i}",) for i in range(300)], "s string")
    out = geocode.expand_abbreviations(asked, "s", pages, html=None)
    assert [tuple(r) for r in out.collect()] == [("via b. roma", "via bruno roma")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan


def test_pages_become_text_once(spark):
    """The reviewed case: filters and both readers of a page's text made it anew; what is left of the plan reads texts."""
    pages = spark.createDataFrame([("<p>in via anna roma</p>",), (None,)], "html string")
    asked = spark.createDataFrame([("via a. roma",)], "s string")
    out = geocode.expand_abbreviations(asked, "s", pages)
    assert [tuple(r) for r in out.collect()] == [("via a. roma", "via anna roma")] and "html" not in out._jdf.queryExecution().executedPlan().toString()
