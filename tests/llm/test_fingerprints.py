import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrajobs.llm import fingerprints as op

from .common import AWKWARD, SMALL, awkward


def test_against_brute_force(spark):
    """Edited texts by brute force; fingerprints by voting in Python over Spark's hashes."""
    got = sorted(map(tuple, op.edited_fingerprints(awkward(spark)).collect()), key=str)
    key = {t: k for t, k in spark.createDataFrame([(r[1] or "",) for r in AWKWARD], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted({(op.NULL_ID if r[0] is None else r[0], key[r[1] or ""], r[1] or "") for r in AWKWARD})
    texts = {}
    for i, (doc, k, text) in enumerate(order):
        half = len(text) // 2
        texts[doc, k] = text[: len(text) - half] + order[(i + 1) % len(order)][2][:half]
    all_texts = sorted({*texts.values(), *(r[1] or "" for r in AWKWARD)})
    whole = spark.createDataFrame(list(enumerate(all_texts)), "n int, t string")
    hashed = whole.select("n", F.posexplode(op.terms(F.col("t"))).alias("p", "x")).select("n", F.xxhash64("x.a", "x.b").alias("h"), F.least(F.length("x.a") + F.coalesce(F.length("x.b"), F.lit(0)), F.lit(16)).alias("w"))
    votes = {}
    for n, h, w in hashed.groupBy("n", "h").agg(F.sum("w")).collect():
        v = votes.setdefault(all_texts[n], [0, np.zeros(64, dtype="i8")])
        v[0] += w
        v[1] += w * np.array([(h >> b) & 1 for b in range(64)])
    fp = {t: sum(1 << b for b in range(64) if v[b] * 2 > n) for t, (n, v) in votes.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = []
    for r in AWKWARD:
        doc, text = (op.NULL_ID if r[0] is None else r[0]), r[1] or ""
        i = next(i for i, o in enumerate(order) if o[:2] == (doc, key[text]))
        edited, following = texts[doc, key[text]], order[(i + 1) % len(order)][2]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), signed(fp[text]), signed(fp[edited]), signed(fp[following])))
    assert got == sorted(want, key=str)


def test_empty_table_and_single_row(spark):
    assert op.edited_fingerprints(awkward(spark, [])).count() == 0
    only = op.edited_fingerprints(awkward(spark, AWKWARD[:1])).collect()
    assert len(only) == 1 and only[0]["fp"] == only[0]["next_fp"]


def test_query(spark):
    out = op.op6_document_fingerprints(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs) and out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    by_text = {}
    for doc_id, fp in zip(out.doc_id, out.fingerprint):
        assert by_text.setdefault(docs.text[doc_id], fp) == fp
    assert out.near_edited.mean() > out.near_next.mean() + 0.1


@pytest.mark.parametrize("radius,blocks", [(0, 1), (1, 3), (3, 5), (4, 6)])
def test_search_finds_all(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype="u8")
    fps = [int(b) for b in base]
    for b in base:
        for n in range(7):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed] + [(signed[0],), (None,)], "fp long")
    queries = spark.createDataFrame([(f,) for f in signed[:60]], "query long")
    got = Counter(map(tuple, op.search(queries, df, radius, blocks).collect()))
    mask = (1 << 64) - 1
    want = {(q, f, bin((q ^ f) & mask).count("1")) for q in set(signed[:60]) for f in set(signed) if bin((q ^ f) & mask).count("1") <= radius}
    assert got == Counter(want)
