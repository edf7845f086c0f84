from collections import Counter

import corpus_pipeline
from terrajobs.llm import mixing

from .common import AWKWARD, SMALL, awkward
from .test_mixing import sizes_of


def hashed(df):
    return Counter(map(tuple, df.collect()))


def test_exact_dedup_keeps_one_row_a_text(spark):
    got = hashed(corpus_pipeline.drop_exact_copies(spark, awkward(spark), SMALL))
    assert set(got) <= set(AWKWARD) and sum(got.values()) == len({r[1] or "" for r in AWKWARD}) and max(got.values()) == 1
    nulls = [(None, "one text", *AWKWARD[0][2:])] * 30
    assert corpus_pipeline.drop_exact_copies(spark, awkward(spark, nulls), SMALL).count() == 1


def test_rows_of_one_id_have_copies_of_their_own(spark):
    """Rows without an id, with the same one, and wholly repeated rows do not multiply each other."""
    rows = [*AWKWARD, *((None, f"text number {i} has no id", *AWKWARD[0][2:]) for i in range(40)), *[AWKWARD[11]] * 20]
    docs = awkward(spark, rows)
    got = hashed(mixing.repeat_documents(docs))
    assert set(got) <= set(rows) and all(n <= mixing.MOST * rows.count(r) for r, n in got.items())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"], r["size"]] += r["copies"]
    out = Counter()
    for (r, n), size in zip(got.items(), sizes_of(got)):
        out[r[3], size] += n
    assert out == +want


def test_stages_on_awkward_rows(spark):
    unique = corpus_pipeline.drop_exact_copies(spark, awkward(spark), SMALL)
    apart = corpus_pipeline.drop_near_copies(spark, unique, SMALL)
    # 5 and 4 have no words; 2 and 12 stay, and both texts of id 10.
    assert Counter(r["doc_id"] for r in apart.collect()) == Counter([2, 4, 6, 7, 8, 9, 10, 10, 11, None, 12])
    mixed = hashed(corpus_pipeline.mix_sources(spark, apart, SMALL))
    assert mixed and set(mixed) <= set(map(tuple, apart.collect())) and max(mixed.values()) <= mixing.MOST
    assert corpus_pipeline.encode_tokens(spark, corpus_pipeline.mix_sources(spark, apart, SMALL), SMALL).count() == sum(mixed.values())


def test_quality_stage_gives_rows_back_as_they_are(spark):
    """Columns named as the stages' own come through with their values."""
    got = hashed(corpus_pipeline.keep_quality(spark, awkward(spark), SMALL))
    assert got and not got - Counter(AWKWARD)
