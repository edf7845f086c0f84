from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from terrajobs.llm import near_copies as op

from .common import AWKWARD, SMALL, awkward
from .test_simhash_segments import plain_fingerprint


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """Rows that are first of their group, by all pairs."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, root = [plain_set(r[1]) for r in order], list(range(len(order)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in combinations(range(len(order)), 2):
        if alike(sets[i], sets[j]):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return Counter(tuple(r) for i, r in enumerate(order) if find(i) == i)


@pytest.fixture(scope="module")
def edited():
    """Texts, copies with a word in a hundred changed (similar at 0.8 or more, most over 4 bits apart), and half copies."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((i, " ".join(words)))
        for k in range(6):
            other = list(words)
            for at in rng.choice(200, 4 if k < 4 else 30, replace=False):
                other[at] = f"x{rng.integers(0, 5000)}"
            rows.append((100 + 10 * i + k, " ".join(other)))
    return rows


def test_near_copies_go_and_others_stay(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string")
    texts = dict(edited)
    far = [(a, b) for a, b in combinations(texts, 2) if alike(plain_set(texts[a]), plain_set(texts[b])) and (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4]
    assert len(far) > 20
    want = brute(edited)
    assert 20 < sum(want.values()) < len(edited)
    assert Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect())) == want
    assert Counter(map(tuple, op.keep_representatives(docs, block=2).collect())) == want


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = op.keep_representatives(docs)
    assert out.columns == docs.columns
    assert Counter(r["text"] or "" for r in out.collect()) == Counter(t for _, t in brute([(r["doc_id"], r["text"] or "") for r in docs.collect()]))


def test_awkward_and_empty(spark):
    got = Counter(r["doc_id"] for r in op.keep_representatives(awkward(spark)).collect())
    assert got == Counter([1, 3, 6, 7, 8, 9, 10, 10, 11, 11, None, 12])
    assert op.keep_representatives(awkward(spark, [])).count() == 0


def test_a_null_id_does_not_keep_other_null_ids(spark, edited):
    rows = [(None, t, *AWKWARD[0][2:]) for _, t in edited[:7]]
    assert sum(brute([(None, r[1]) for r in rows]).values()) == op.keep_representatives(awkward(spark, rows)).count() < len(rows)
