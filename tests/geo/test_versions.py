"""Reference tables that change as a whole, and one-to-one similarity by groups."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrajobs.operators import matching, registry


def test_a_job_that_dies_between_two_tables_leaves_the_old_ones(spark, tmp_path):
    folder = str(tmp_path / "tables")
    tables = lambda n: {k: spark.range(n).select(F.lit(n).alias("version"), "id") for k in ("comune", "provincia")}
    seen = lambda: [registry.get_areas(spark, folder, k).agg(F.max("version")).first()[0] for k in ("comune", "provincia")]
    with pytest.raises(FileNotFoundError):
        registry.get_areas(spark, folder, "comune")
    first = registry.write_reference_tables(tables(1), folder)
    assert seen() == [1, 1]
    open_ = registry.get_areas(spark, folder, "comune")
    broken = tables(2) | {"provincia": spark.range(1).select(F.raise_error(F.lit("lost")).cast("int").alias("version"), "id")}
    with pytest.raises(Exception, match="lost"):
        registry.write_reference_tables(broken, folder)
    assert seen() == [1, 1] and len([n for n in os.listdir(folder) if n.startswith("v")]) == 2
    second = registry.write_reference_tables(tables(3), folder)
    # Who reads the version before still can; what the dead job left is gone.
    assert seen() == [3, 3] and open_.count() == 1 and sorted(n for n in os.listdir(folder) if n.startswith("v")) == sorted([first, second])
    registry.write_reference_tables(tables(4), folder)
    assert seen() == [4, 4] and first not in os.listdir(folder)


def in_order(pairs):
    words, known, out = set(), set(), set()
    for word, name, ratio in sorted(sorted(pairs, key=lambda p: p[1], reverse=True), key=lambda p: (-p[2], p[0])):
        if word not in words and name not in known:
            words.add(word)
            known.add(name)
            out.add((word, name, ratio))
    return out


@pytest.mark.parametrize("most", [20_000, 3])
def test_pairs_taken_once_equal_the_sequential_rule(spark, most):
    rng = random.Random(most)
    pairs = list({(f"w{rng.randrange(60)}", f"n{rng.randrange(60)}"): None for _ in range(110)})
    pairs = [(w, n, rng.randint(86, 90) / 100) for w, n in pairs]
    df = spark.createDataFrame(pairs, "word string, name string, ratio double")
    assert {tuple(r) for r in matching.assign_once(df, most).collect()} == in_order(pairs)
    assert matching.assign_once(df.limit(0), most).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    """Each of 1,000 words likes the next one's name best of all: by rounds one word a round would be settled."""
    n = 1000
    pairs = [(f"w{i:04d}", f"n{i:04d}", 0.9 + i / 20_000) for i in range(n)] + [(f"w{i:04d}", f"n{i + 1:04d}", 0.9 + i / 20_000 + 1 / 40_000) for i in range(n - 1)]
    out = matching.assign_once(spark.createDataFrame(pairs, "word string, name string, ratio double"))
    assert {tuple(r) for r in out.collect()} == in_order(pairs)


def test_pairs_that_are_told_apart_need_no_groups(spark, monkeypatch):
    """Two rounds of pairs that are each other's best settle these; one large table of groups is not built."""
    monkeypatch.setattr(matching, "connected_components", None)
    pairs = [(f"w{i:02d}", f"n{i:02d}", 0.95) for i in range(40)] + [("w00", "n01", 0.9), ("w40", "n00", 0.9), ("w40", "n40", 0.89), ("w41", "n40", 0.88)]
    out = matching.assign_once(spark.createDataFrame(pairs, "word string, name string, ratio double"))
    assert {tuple(r) for r in out.collect()} == in_order(pairs)


def test_a_group_is_taken_in_order_across_batches():
    rng = random.Random(3)
    pairs = pd.DataFrame([("g", f"w{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randint(86, 90) / 100) for _ in range(60)], columns=["_group", "word", "name", "ratio"])
    pairs = pairs.drop_duplicates(["word", "name"]).sort_values(["ratio", "word", "name"], ascending=[False, True, False])
    both = pd.concat([pairs, pairs.assign(_group="h")])
    batches = [both.iloc[i : i + 7] for i in range(0, len(both), 7)]
    got = [tuple(r) for part in matching._in_order(iter(batches)) for r in part.itertuples(index=False)]
    want = in_order([tuple(r) for r in pairs[["word", "name", "ratio"]].itertuples(index=False)])
    assert len(got) == 2 * len(want) and set(got) == want
