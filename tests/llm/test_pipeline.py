import hashlib
from collections import Counter

import corpus_pipeline
from terrajobs.llm import bpe_trie, simhash_segments

from .common import SMALL
from .test_simhash_segments import components, plain_fingerprint
from .test_near_copies import brute as brute_near
from .test_mixing import brute_targets, sizes_of


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark):
    """Each stage over all that its predecessor kept; run() gives the rows of the last."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert 4 <= len(stages) <= 5
    good = stages["quality classifier"](spark, docs, SMALL)
    assert good.columns == columns and set(rows(good)) < set(rows(docs))

    unique = stages["exact dedup"](spark, good, SMALL)
    last = {}
    for r in rows(good):
        last[r[1]] = max(last.get(r[1], r), r)
    assert unique.columns == columns and sorted(rows(unique)) == sorted(last.values())

    # Five-word shingles and a similarity of 0.8, against all pairs; components of 4 bits are op4's own and are held to below.
    apart = stages["simhash near-dedup"](spark, unique, SMALL)
    assert apart.columns == columns and Counter(rows(apart)) == brute_near(rows(unique))

    mixed = stages["mix sources"](spark, apart, SMALL)
    had, out = sorted(rows(apart)), Counter(rows(mixed))
    sizes = sizes_of(had)
    per_source, taken = Counter(), Counter()
    for r, n in zip(had, sizes):
        per_source[r[3]] += n
        taken[r[3]] += out[r] * n
    assert mixed.columns == columns and set(out) <= set(had) and max(out.values()) <= 3
    for source, target in brute_targets(per_source).items():
        assert abs(taken[source] - target) <= 2 * max(n for r, n in zip(had, sizes) if r[3] == source)

    encoder = bpe_trie.TrieEncoder(bpe_trie.vocabulary_path())
    want = Counter()
    for r, n in out.items():
        ids = [i for part in encoder.encode(r[1]) for i in part]
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] += n
    assert Counter(rows(stages["bpe"](spark, mixed, SMALL))) == want
    assert Counter(rows(corpus_pipeline.run(spark, SMALL))) == want


def test_simhash_representatives_against_brute_force(spark):
    """The smallest doc_id of each 4-bit component stays, by op4's own operator."""
    had = sorted(rows(spark.read.parquet(f"{SMALL}/documents.parquet")))
    roots = components([plain_fingerprint(r[1]) for r in had], 4)
    kept = simhash_segments.keep_representatives(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sorted(rows(kept)) == [r for i, r in enumerate(had) if roots[i] == i]


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0
