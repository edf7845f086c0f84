import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrajobs.llm import quality_rules as op

from .common import AWKWARD, SMALL, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """By the rules' own words, over characters."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_equal_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op.op11_quality_rules(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    for r in rows:
        n, chars, symbols, dup, repeat = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        failed = n < 20 or 100 * repeat > 30 * n
        assert r["base_failed"] == failed and not (failed and r["kept"]) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "text",
    [None, "", " \t\x0b\x0c\r\n", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "# $ %\n\n# $ %\n # $ %", "é ü 🙂\x1c\x85 \xa0", "a b c d e f g h i a b c d e f g h j " * 2, "\n\n \n\x0b\n"],
)
def test_counts_of_small_texts(text):
    assert op.measure(None if text is None else text.encode())[:5] == brute(text)


def test_held_out_documents(spark):
    """Fold 0, which the forest has not seen: nearly all good documents stay, most bad ones go."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op.op11_quality_rules(spark, folder).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = [r for r in rows.collect() if not r["base_failed"]]
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 500 and np.mean(good) >= 0.99 and len(bad) > 50 and np.mean(bad) <= 0.1


def test_the_model_is_the_same_however_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a, b = op.fit(docs, labels), op.fit(docs.repartition(7, "n_chars"), labels.repartition(3))
    assert a.threshold == b.threshold and np.array_equal(a.split, b.split) and np.array_equal(a.path, b.path)
    few = op.labelled_sample(docs, labels, 9)
    assert few.count() == 9 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in few.collect())


def test_paths_are_shorter_where_no_good_document_is():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(500, 6))
    forest = op.grow_forest(good, np.vstack([good, np.full((1, 6), 12.0)]))
    near, far = forest.score(np.zeros((1, 6)))[0], forest.score(np.full((1, 6), 9.0))[0]
    assert near < 0.6 < far
    assert op.usual_path(2) == 1 and op.usual_path(1) == 0 and 10 < op.usual_path(256) < 11


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    forest = op.fit(docs, labels)
    rows = op.judge(docs, forest).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in AWKWARD)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(not by_id[i]["kept"] and by_id[i]["base_failed"] and by_id[i]["n_words"] == 0 for i in (3, 4, 5)) and by_id[6]["n_words"] == 240_000
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_no_rows_and_no_labels(spark):
    docs, none = awkward(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert op.judge(docs, op.fit(docs, none)).count() == 0
    text = " ".join(f"word{i}" for i in range(30))
    some = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in op.judge(some, op.fit(some, none)).collect()} == {1: True, 2: False}


def test_all_labelled_documents_take_part(spark):
    """The reviewed case: of more than 20,000 labelled documents those of least hash were seen."""
    ids = spark.range(26_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 997).cast("string")) for k in range(1, 26))).alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 9 > 0).cast("int").alias("quality"))
    outside = [i for i in range(26_000) if zlib.crc32(str(i).encode()) % 5]
    assert len(outside) > 20_000 and op.labelled_sample(docs, labels).count() == len(outside)
    rows = op.labelled_sample(docs, labels).orderBy("doc_id").toPandas()
    x, good = op.features(rows[list(op.STATISTICS)].to_numpy(np.int64)), rows["quality"].to_numpy() == 1
    plain, got = op.grow_forest(x[good & (rows["fold"].to_numpy() < 4)], x), op.fit(docs, labels)
    assert np.array_equal(plain.path, got.path) and np.array_equal(plain.split, got.split)
    passes = (rows["n_words"] >= op.LEAST_WORDS).to_numpy() & (100 * rows["n_repeat_words"] <= op.MOST_REPEATED * rows["n_words"]).to_numpy()
    scores = np.sort(plain.score(x[good & passes & (rows["fold"].to_numpy() == 4)]))
    assert got.threshold == scores[int(np.ceil(op.KEEP * len(scores))) - 1]


def test_threshold_by_counts(spark):
    rng = np.random.default_rng(1)
    for values in ([0.5], [0.25] * 40, list(rng.random(3000)), [0.1 + 1e-15 * int(i) for i in rng.integers(0, 50, 400)]):
        scores = spark.createDataFrame([(float(v),) for v in values], "score double")
        for keep in (0.001, 0.5, 0.999, 1.0):
            assert op.least_kept(scores, keep) == sorted(values)[int(np.ceil(keep * len(values))) - 1]
    assert op.least_kept(spark.createDataFrame([], "score double"), 0.5) is None
