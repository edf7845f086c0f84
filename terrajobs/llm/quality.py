"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of a text approximate, through random Fourier features, a Gaussian kernel between documents. Ridge
regression on those features is solved from its normal equations, which tasks sum over their own rows and Spark sums
over tasks. Scores are then calibrated by isotonic regression on a fold that the ridge did not see.

Features are rounded to multiples of 2**-16, so the sums of their products are exact in doubles up to two million rows:
the model does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.columns import rows_that
from terrajobs.functions.storage import materialize

#: Random Fourier features and the kernel's width, in standard deviations of a statistic times root of their number.
FEATURES = 192
WIDTH = 1.0
RIDGE = 1e-3
#: Labelled rows that the ridge and the calibration are fitted on, at most (in expectation): a sample by hash of doc_id.
MAX_ROWS = 200_000
#: Score from which a document is good.
THRESHOLD = 0.3
#: Folds of crc32(doc_id) mod 5: 0 is held out, 4 calibrates, the rest fit.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
#: Levels of the raw score that calibration tells apart.
LEVELS = 2048
QUANTUM = 1 << 16
#: Words in a window of the repetition statistics, and bytes of a text handled at a time.
WINDOW = 256
CHUNK = 1 << 22

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+<=>@^_~\\/{}[]",
    "blank": b" \t\x0b\x0c\r",
    "line": b"\n",
    "far": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)), dtype="f8")
for _k, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _k] = 1.0
STATISTICS = ("log_bytes", "log_words", "word_bytes", "distinct", "repeats", "long_words", *_CLASSES)


def statistics(text: str | None) -> np.ndarray:
    """The document statistics of a whole text; null counts as empty, all of whose statistics are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    histogram, n_words, word_bytes, windows, distinct, repeats, long_words = np.zeros(256), 0, 0, 0, 0.0, 0, 0
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data) and (gap := data.rfind(b" ", at + 1, end)) > 0:
            end = gap
        chunk = data[at:end]
        at = end
        histogram += np.bincount(np.frombuffer(chunk, dtype="u1"), minlength=256)
        words = chunk.split()
        n_words += len(words)
        repeats += sum(map(eq, words, islice(words, 1, None)))
        sizes = np.fromiter(map(len, words), dtype="i8", count=len(words))
        word_bytes += int(sizes.sum())
        long_words += int((sizes > 20).sum())
        for i in range(0, len(words), WINDOW):
            some = words[i : i + WINDOW]
            # As many distinct words as a window of that length has in prose grow less than it: scale short ones by root.
            distinct += len(set(some)) / len(some) ** 0.9
            windows += 1
    n = max(1, len(data))
    return np.array(
        [np.log1p(len(data)), np.log1p(n_words), word_bytes / max(1, n_words) / 10, distinct / max(1, windows), repeats / max(1, n_words), long_words / max(1, n_words), *(histogram @ _TABLE / n)],
        dtype="f4",
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass
class Model:
    """All that scoring needs; small, whatever the data."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant, in multiples of 1/QUANTUM."""
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos((x - self.mean) / self.scale @ self.waves + self.phases)
        return np.hstack([np.round(waves * QUANTUM) / QUANTUM, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.levels, self.values)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _gram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.phases) + 1, len(model.phases) + 2))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                phi = model.features(np.stack(some["stats"].to_numpy(zero_copy_only=False)).astype("f8"))
                y = np.round(some["quality"].to_numpy(zero_copy_only=False) * QUANTUM) / QUANTUM
                total += phi.T @ np.hstack([phi, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def _raw_levels(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.stack(batch["stats"].to_numpy(zero_copy_only=False)).astype("f8"))
                level = np.clip(np.floor((raw + 1) / 3 * LEVELS), 0, LEVELS - 1).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(level), batch["quality"]], names=["level", "quality"])

    return run


def pool_adjacent_violators(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []  # sum, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks])


def sample_labels(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, quality`` of the labelled documents to learn from: none of fold 0, ``max_rows`` at most in expectation.

    Labels that repeat for a document count as their mean; null ids and null labels are left out.
    """
    said = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != HELD_OUT))
    said = said.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    n = said.count()
    return said if n <= max_rows else said.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(max_rows / n * (1 << 30))))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 0) -> Model:
    """Fit on ``stats`` (doc_id, stats) with ``labels`` (doc_id, quality), rows of fold 0 left out.

    To the driver come: one row of means and deviations, one summed row of the normal equations per feature, and one row
    per score level. Without labels, or with one class, scores are its share (0.5 without labels).
    """
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    waves = rng.normal(0.0, 1.0 / (WIDTH * np.sqrt(d)), (d, FEATURES))
    phases = rng.uniform(0.0, 2 * np.pi, FEATURES)
    model = Model(np.zeros(d), np.ones(d), waves, phases, np.zeros(FEATURES + 1), np.array([-1.0, 2.0]), np.array([0.5, 0.5]))

    said = sample_labels(labels, max_rows)
    # A bounded sample, so a few partitions and as many partial sums.
    rows = materialize(said.join(stats, "doc_id").select("doc_id", "stats", "quality").repartition(16, "doc_id"), "labelled")
    moments = rows.agg(
        F.count("*"), F.avg("quality"), *(F.avg(F.col("stats")[i].cast("double")) for i in range(d)), *(F.stddev_pop(F.col("stats")[i].cast("double")) for i in range(d))
    ).first()
    if not moments[0] or moments[1] in (0.0, 1.0):
        share = 0.5 if not moments[0] else float(moments[1])
        model.values = np.array([share, share])
        return model
    short = lambda xs: np.array([float(f"{x:.6g}") for x in xs])  # noqa: E731  the order of summing shows in later digits
    model.mean, model.scale = short(moments[2 : 2 + d]), np.maximum(short(moments[2 + d :]), 1e-6)

    fitted = rows.where(fold() != CALIBRATE)
    partial = fitted.select("stats", "quality").mapInArrow(_gram(model), "i int, sums array<double>")
    total = partial.groupBy("i").agg(*(F.sum(F.col("sums")[j]).alias(str(j)) for j in range(FEATURES + 2))).orderBy("i").collect()
    sums = np.array([list(r)[1:] for r in total])
    gram, moment = sums[:, :-1], sums[:, -1]
    count = max(1.0, gram[-1, -1])
    penalty = RIDGE * count / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9 * count
    model.weights = np.linalg.solve(gram + penalty, moment)

    held = rows.where(fold() == CALIBRATE).select("stats", "quality").mapInArrow(_raw_levels(model), "level int, quality double")
    by_level = held.groupBy("level").agg(F.avg("quality"), F.count("*")).orderBy("level").collect()
    if by_level:
        at, value, weight = (np.array(x, dtype="f8") for x in zip(*by_level, strict=True))
        model.levels = (at + 0.5) / LEVELS * 3 - 1
        model.values = np.clip(np.round(pool_adjacent_violators(value, weight), 9), 0.0, 1.0)
    else:  # too few labels for a fold: the ridge score itself
        model.levels, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_statistics(model: Model):
    @F.pandas_udf(T.DoubleType())
    def run(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy()).astype("f8")) if len(stats) else [], dtype="f8")

    return run


def score_texts(model: Model):
    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts]).astype("f8")) if len(texts) else [], dtype="f8")

    return run


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of every row, written to the shared folder: texts are read once, statistics are small."""
    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics_of(F.coalesce(text_col, F.lit(""))).alias("stats")), "stats")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Empty and null texts are scored as texts without words. Repeated rows get a row each, and equal texts equal scores. No
    column but the text enters a score. No rows give no rows.
    """
    stats = with_statistics(docs, id_col, text_col)
    model = fit(stats, labels)
    scored = stats.select("doc_id", (fold() == HELD_OUT).alias("held_out"), score_statistics(model)("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score from ``threshold`` up.

    Statistics are taken of the documents that the fit sees, whose ids (MAX_ROWS at most) are broadcast, and then once of
    every text where it is scored.
    """
    learned = rows_that(docs, [docs["doc_id"].cast("long")], F.broadcast(sample_labels(labels)), ["doc_id"])
    model = fit(with_statistics(learned), labels)
    return docs.where(score_texts(model)(F.coalesce("text", F.lit(""))) >= threshold)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
