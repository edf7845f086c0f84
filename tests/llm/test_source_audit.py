import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrajobs.llm import source_audit as op

from .common import AWKWARD, SMALL, awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(lang, source, text) rows, by the definition."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(FOLD))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def share(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}

        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            told = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", told, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return Counter(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return Counter(map(tuple, df.collect()))


def texts(df):
    return [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]


def test_query_equals_brute_force(spark):
    assert got(op.op13_source_audit(spark, SMALL)) == brute(texts(spark.read.parquet(f"{SMALL}/documents.parquet")))


def test_segments_blocks_and_partitions_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute(texts(df))
    monkeypatch.setattr(op, "SEGMENT", 50)
    monkeypatch.setattr(op, "GROUPS_A_BLOCK", 3)
    monkeypatch.setattr(op, "HELD", 100)
    assert got(op.audit(df.repartition(5))) == want


def test_awkward_rows(spark):
    rows = AWKWARD + [(20 + i, f"Ünder ünder ÜNDER one two a{i}b word_{i % 2} X\x7fy\x00z 🙂é", ("en", None, "")[i % 3], ("a", None, "b", "", "Z")[i % 5], *AWKWARD[0][4:]) for i in range(40)]
    df = awkward(spark, rows)
    assert got(op.audit(df)) == brute(texts(df))


def test_languages_without_kept_terms_and_no_rows(spark):
    df = spark.createDataFrame([("x", "a", "one"), ("x", "b", "two"), ("x", "c", None), ("y", "a", ". 1 2 3")], "lang string, source string, text string")
    rows = op.audit(df).collect()
    assert Counter((r["source"], r["item"], r["value"], r["rank"]) for r in rows) == Counter([("a", "b", 0, 1), ("a", "c", 0, 2), ("b", "a", 0, 1), ("b", "c", 0, 2), ("c", "a", 0, 1), ("c", "b", 0, 2)])
    assert not got(op.audit(df.limit(0)))


@pytest.mark.parametrize("text", ["", "Aa bB", "É é", "x1y", "[a]`b{c}~d\x7fe", "tab\tnew\nline\x0bz", "日本 語", "a" * 1000])
def test_terms_of_bytes_and_of_characters(text):
    assert [t.decode() for t in op.terms(text.encode())] == TERM.findall(text.translate(FOLD))


def test_walk_meets_every_pair_of_leaves_and_prices_it_once():
    rng = np.random.default_rng(1)
    leaves = np.where(rng.random((6, 64)) < 0.2, rng.integers(0, 4, (6, 64)), 0)
    roots, levels = op.consed(leaves)
    assert len(levels) == 6 and len(levels[0][0]) <= 6
    for a in range(6):
        for b in range(6):
            x, y, down = op.walk(int(roots[a]), int(roots[b]), levels)
            assert len(x) == len({*zip(x.tolist(), y.tolist())}) == len({*zip(leaves[a].tolist(), leaves[b].tolist())})
            assert op.priced((x - 3 * y) ** 2, down) == sum((int(p) - 3 * int(q)) ** 2 for p, q in zip(leaves[a], leaves[b]))
    alike, levels = op.consed(np.zeros((3, 1024), int))
    assert len(set(alike.tolist())) == 1 and all(len(left) == 1 for left, _ in levels)


def test_shares_of_counts_beyond_64_bits(spark):
    counts = [(0, 10, 3), (9 * 10**9, 10**13, 7), (10**12, 3 * 10**12, 10**6), (8_999_999_999, 10**10, 1)]
    df = spark.createDataFrame(counts, "n long, t long, v long").select("n", "t", "v", op.share(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    want = {n: 1 + 10**9 * (n + 1) // (t + v) for n, t, v in counts}
    assert {r["n"]: r["p"] for r in df.collect()} == want
    assert all(op.shares(np.array([n]), t + v)[0] == want[n] for n, t, v in counts)


def test_pairs_of_groups_that_have_none_of_a_segments_terms():
    rows = pa.table({"source": ["a"], "term": ["x"], "n": [5], "total": [5]})
    groups = pa.table({"lang": ["l"] * 3, "source": ["a", "b", "c"], "n_group": [5, 0, 0], "v": [3] * 3, "block": [0] * 3, "i": [0] * 3, "j": [0] * 3, "in_segment": [3] * 3})
    found = {(r["a"], r["b"]): r["price"] for r in op.compare(rows, groups).to_pylist()}
    p, q = [1 + 10**9 * (n + 1) // 8 for n in (5, 0, 0)], [1 + 10**9 // 3] * 3
    assert found["a", "b"] == sum((x - y) ** 2 // y for x, y in zip(p, q)) and found["b", "a"] == sum((x - y) ** 2 // x for x, y in zip(p, q)) and found["b", "c"] == 0 and len(found) == 6
