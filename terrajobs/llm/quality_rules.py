"""Quality rules and an isolation forest over their statistics.

Every text is counted once. Two rules decide by themselves (too few words, too much said twice); what passes them is held to an isolation
forest: trees of random splits over the box of all labelled documents, in whose parts all those labelled good are counted. A document that lies where few
good ones are is alone after few splits, so its mean path is short. The path from which a document counts as odd is
the one that nearly all good documents of a fold of their own pass. Box, counts and that path are summed up by Spark over all labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.storage import materialize

#: Fewest words, and the share of words (in percent) in repeated windows from which a text fails.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Trees, the number of good documents that counts are scaled to where there are more, and splits on a path.
TREES, PER_TREE, DEPTH = 200, 256, 12
#: Parts of the range of scores that are counted at once to find the threshold.
PARTS = 4096
#: Share of the good calibration documents that stay.
KEEP = 0.999
SEED = 11
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes")
_COUNTS = pa.struct([(name, pa.int64()) for name in STATISTICS])
_KIND = T.StructType([T.StructField(name, T.LongType()) for name in STATISTICS])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in some window of ``window`` (a power of two) words that the text has twice or more. ``ids``: a number for each word.

    Windows are told apart exactly: a window's number is that of the pair of its halves' numbers.
    """
    if len(ids) <= window:
        return 0
    of, half = ids, 1
    while half < window:
        of = np.unique(of[:-half] * (int(of.max()) + 1) + of[half:], return_inverse=True)[1]
        half *= 2
    again = np.flatnonzero(np.bincount(of)[of] > 1)
    if not len(again):
        return 0
    edge = np.bincount(again, minlength=len(ids) + 1) - np.bincount(again + window, minlength=len(ids) + 1)
    return int((np.cumsum(edge)[: len(ids)] > 0).sum())


def measure(text: bytes | None) -> tuple:
    """STATISTICS of a text in UTF-8. Words are runs of anything but ASCII white space; null has none.

    ``n_dup_lines`` are lines with a word that equal an earlier one, ``n_lines`` all lines with a word, ``n_echoes`` words equal to the word before.
    """
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    # In UTF-8 a code point has one byte that is no continuation.
    chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), int((ids[1:] == ids[:-1]).sum())


@F.arrow_udf(_KIND)
def statistics(text: pa.Array) -> pa.Array:
    """A struct of STATISTICS of each text."""
    rows = [measure(t) for t in text.cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(STATISTICS))], fields=list(_COUNTS))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The rules that decide by themselves."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of STATISTICS as lengths and shares; shares on a scale on which a thousandth counts."""
    words, chars, symbols, dup, repeat, lines, echoes = counts.T.astype(float)
    share = lambda a, b: np.log2(1 + 1000 * a / np.maximum(b, 1))
    return np.column_stack([np.log2(words + 1), chars / np.maximum(words, 1), share(symbols, chars), share(dup, lines), share(repeat, words), share(echoes, words)])


def usual_path(n: int) -> float:
    """Mean depth of a search in a random tree over ``n`` points that fails: what a leaf of ``n`` points would have grown to."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _usual_paths(n: np.ndarray) -> np.ndarray:
    """The same of numbers that need not be whole."""
    return np.where(n <= 2, np.clip(n - 1, 0, 1), 2 * (np.log(np.maximum(n, 2) - 1) + 0.5772156649015329) - 2 * (np.maximum(n, 2) - 1) / np.maximum(n, 2))


@dataclass
class Forest:
    """Trees as arrays (a row a tree, a column a node), and the score from which a document is odd. Without trees nothing is."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher where paths are shorter."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, child[at] + (x[rows, np.maximum(f, 0)] >= split[at]))
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.scale) if len(self.feature) else np.zeros(len(x))


def _split_box(low: np.ndarray, high: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, split) of the inner nodes of all trees, the children of node i being 2 i + 1 and 2 i + 2: a random wide side of the node's box, cut anywhere."""
    rng = np.random.default_rng(seed)
    inner, every = (1 << DEPTH) - 1, np.arange(TREES)
    feature, split = np.zeros((TREES, inner), np.int8), np.zeros((TREES, inner))
    lows, highs = {0: np.tile(low, (TREES, 1))}, {0: np.tile(high, (TREES, 1))}
    for node in range(inner):
        low, high = lows.pop(node), highs.pop(node)
        f = np.where(high > low, rng.random(low.shape), -1.0).argmax(1)
        cut = rng.uniform(low[every, f], high[every, f])
        feature[:, node], split[:, node] = f, cut
        below, above = high.copy(), low.copy()
        below[every, f] = above[every, f] = cut
        lows |= {2 * node + 1: low, 2 * node + 2: above}
        highs |= {2 * node + 1: below, 2 * node + 2: high}
    return feature, split


def _parts(x: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The number of the leaf of each tree (TREES rows) that each row of ``x`` is in, trees in a row: tree * 2^DEPTH + leaf."""
    out, rows = np.empty((len(feature), len(x)), np.int64), np.arange(len(x))
    for i, (of, at_split) in enumerate(zip(feature, split, strict=True)):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, of[at]] >= at_split[at])
        out[i] = (i << DEPTH) + at - ((1 << DEPTH) - 1)
    return out


def _forest(feature: np.ndarray, split: np.ndarray, counts: np.ndarray, total: int) -> Forest:
    """The forest of splits and the number of good documents in each leaf. A path ends at the first node that holds less than two, of PER_TREE where there are more."""
    trees, n = len(feature), min(PER_TREE, total)
    levels = [counts.reshape(trees, -1) * (n / max(1, total))]
    while levels[0].shape[1] > 1:
        levels.insert(0, levels[0][:, 0::2] + levels[0][:, 1::2])
    depth = np.concatenate([np.full(1 << d, d) for d in range(DEPTH + 1)])
    inside = np.concatenate(levels, axis=1)
    ends = (inside < 2) | (depth == DEPTH)
    # Of the whole trees only the nodes that paths come to stay, the two children of one next to each other.
    met = np.zeros(inside.shape, bool)
    met[:, 0] = True
    for node in range(feature.shape[1]):
        met[:, 2 * node + 1] = met[:, 2 * node + 2] = met[:, node] & ~ends[:, node]
    most = int(met.sum(1).max())
    features_, splits, child, path = np.full((trees, most), -1, np.int64), np.zeros((trees, most)), np.zeros((trees, most), np.int64), np.zeros((trees, most))
    for i in range(trees):
        kept = np.flatnonzero(met[i])
        number, last = np.cumsum(met[i]) - 1, ends[i, kept]
        inner = np.where(last, 0, kept)
        features_[i, : len(kept)] = np.where(last, -1, feature[i, inner])
        splits[i, : len(kept)] = np.where(last, 0.0, split[i, inner])
        child[i, : len(kept)] = np.where(last, 0, number[2 * inner + 1])
        path[i, : len(kept)] = np.where(last, depth[kept] + _usual_paths(inside[i, kept]), 0.0)
    return Forest(features_, splits, child, path, usual_path(max(n, 2)))


def _no_forest() -> Forest:
    none = np.zeros((0, 1))
    return Forest(none.astype(np.int64), none, none.astype(np.int64), none, 1.0)


def grow_forest(good: np.ndarray, box: np.ndarray, seed: int = SEED) -> Forest:
    """A forest on the rows ``good`` whose splits fall anywhere in the box of the rows ``box``."""
    if not len(good):
        return _no_forest()
    feature, split = _split_box(box.min(0), box.max(0), seed)
    return _forest(feature, split, np.bincount(_parts(good, feature, split).ravel(), minlength=TREES << DEPTH), len(good))


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, s`` (STATISTICS) of every row of ``docs`` (doc_id, text), written, so that fit and verdicts read a text once."""
    return materialize(docs.select("doc_id", statistics("text").alias("s")), "counted")


def _labelled(told: DataFrame, labels: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``doc_id, fold, quality, s`` of the labelled rows of ``told`` (doc_id, s) outside fold 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("fold", fold).where("fold > 0")
    if max_rows is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return told.join(known, "doc_id").groupBy("doc_id", "fold", "quality").agg(F.max("s").alias("s"))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``doc_id, fold, quality, STATISTICS`` of the labelled documents outside fold 0: all, or the ``max_rows`` of least hash.

    A document with several labels is as good as the worst; of rows with one id one is taken.
    """
    told = docs.select("doc_id", statistics("text").alias("s"))
    return _labelled(told, labels, max_rows).select("doc_id", "fold", "quality", "s.*")


def _table(counts: pa.Array) -> np.ndarray:
    """Features of a struct of STATISTICS."""
    return features(np.column_stack([counts.field(i).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))]) if len(counts) else np.zeros((0, len(STATISTICS))))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(counts: pa.Array) -> pa.Array:
    return pa.array(list(_table(counts)), pa.list_(pa.float64()))


def _count_parts(good: DataFrame, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """How many rows of ``good`` (s) each leaf of each tree holds. Tasks send their sums: at most a row a leaf, whatever they read."""

    def count(batches):
        sums = np.zeros(TREES << DEPTH, np.int64)
        for batch in batches:
            sums += np.bincount(_parts(_table(batch.column(0)), feature, split).ravel(), minlength=len(sums))
        part = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["part", "n"])

    rows = good.select("s").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TREES << DEPTH, np.int64)
    out[rows["part"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def least_kept(scores: DataFrame, keep: float) -> float | None:
    """Of ``scores`` (score), the least that is not below a share ``keep`` of them; null without rows.

    Exact: the part of the range that holds it is cut into PARTS again and again, and only counts come to the driver.
    """
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    left = math.ceil(keep * n)
    while n and low < high:
        width = (high - low) / PARTS
        part = F.least(F.floor((F.col("score") - low) / width), F.lit(PARTS - 1)) if width > 0 else F.lit(0)
        within = scores.where(F.col("score").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in within.orderBy("low").collect():
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low


def fit(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> Forest:
    """The forest of all labelled documents: see ``fit_counted``."""
    return fit_counted(docs.select("doc_id", statistics("text").alias("s")), labels, keep, seed)


def fit_counted(told: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> Forest:
    """The forest of the labelled rows of ``told`` (doc_id, s): the good of folds 1 to 3 are counted in it, its threshold comes from the good of fold 4 (else of all).

    All of them take part; the box, a count a leaf and counts of scores come to the driver. Documents that the rules reject take no part in the threshold. Without good ones there are no trees.
    """
    rows = materialize(_labelled(told, labels).withColumn("x", _features("s")), "labelled")
    sides = range(len(features(np.zeros((1, len(STATISTICS))))[0]))
    box = rows.agg(*(F.min(F.col("x")[i]) for i in sides), *(F.max(F.col("x")[i]) for i in sides)).first()
    grown = rows.where("quality = 1 AND fold < 4").select("s")
    total, forest = grown.count(), _no_forest()
    if total:
        feature, split = _split_box(np.array(box[: len(sides)]), np.array(box[len(sides) :]), seed)
        forest = _forest(feature, split, _count_parts(grown, feature, split), total)
    passes = rows.where(F.col("quality") == 1).where(~base_failed(F.col("s.n_words"), F.col("s.n_repeat_words")))
    last = passes.where("fold = 4")
    scores = materialize((passes if last.isEmpty() else last).select(oddness(forest)("s").alias("score")), "scores")
    if (kept := least_kept(scores, keep)) is not None:
        forest.threshold = float(kept)
    return forest


def oddness(forest: Forest):
    """Arrow UDF: the forest's score of a struct of STATISTICS."""

    @F.arrow_udf(T.DoubleType())
    def score(counts: pa.Array) -> pa.Array:
        return pa.array(forest.score(_table(counts)), pa.float64())

    return score


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, STATISTICS, ``base_failed, score, kept`` of every row of ``docs`` (doc_id, text).

    ``kept`` is false where a rule fails or the score is above the forest's threshold. Null and empty texts fail for want of
    words; repeated rows and null ids are rows of their own; no rows give no rows. Other columns are not looked at.
    """
    return judge_counted(docs.select("doc_id", statistics("text").alias("s")), forest)


def judge_counted(told: DataFrame, forest: Forest) -> DataFrame:
    """The same of rows that are counted (doc_id, s)."""
    told = told.select("doc_id", "s", oddness(forest)("s").alias("score"))
    failed = base_failed(F.col("s.n_words"), F.col("s.n_repeat_words"))
    return told.select("doc_id", "s.*", failed.alias("base_failed"), "score", (~failed & (F.col("score") <= forest.threshold)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that rules and forest keep, with all their columns, whatever these are called."""
    forest = fit(docs, labels)
    own = docs.select(*(docs[c].alias(f"_own{i}") for i, c in enumerate(docs.columns)), statistics(docs["text"]).alias("_s"))
    good = ~base_failed(F.col("_s.n_words"), F.col("_s.n_repeat_words")) & (oddness(forest)("_s") <= forest.threshold)
    return own.where(good).select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; the forest is fitted on the labels at hand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = counted(docs)
    told = judge_counted(docs, fit_counted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
