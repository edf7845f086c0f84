"""Language identification by Bayesian evidence fusion.

Four sources of evidence meet in one posterior: the text's likelihood under byte-trigram models, the language that the page's
markup declares, the suffix of its address, and a prior from the pages of its host. The host's prior shrinks to that of its
registered domain, and the domain's to that of all pages. How far to believe a declaration or a suffix is learned from how
often each goes with what the texts alone say, by grouped counts over all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from terrajobs.functions.storage import materialize
from terrajobs.llm.hosts import domain_of, host_of, path_of, suffix_of

#: Documents of each language that the text models are fitted on, at most (in expectation), by hash of doc_id.
SAMPLE_PER_LANGUAGE = 2000
#: Hashed trigrams, and trigrams that a text's likelihood counts for at most (neighbours in prose are not independent).
BUCKETS = 1 << 15
MOST_TRIGRAMS = 100
#: Documents of fold crc32(doc_id) mod 5 = 0 are left out of fitting, so that accuracy can be measured on them.
FOLDS, HELD_OUT = 5, 0
#: Pages for which a parent's prior counts, and pseudo-counts of a declaration or suffix.
STRENGTH = 20.0
PSEUDO = 1.0
#: Bytes of tallies that a join may broadcast; of a larger table only its hottest keys, as many as fit, are.
BROADCAST_BYTES = 16 << 20
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype="u4")
_FOLD[65:91] += 32  # A-Z as a-z


def trigrams(data: bytes) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of a text with A-Z lower-cased, some at a time; the text is set between spaces."""
    data = b" " + data + b" "
    for at in range(0, max(1, len(data) - 2), CHUNK):
        b = _FOLD[np.frombuffer(data[at : at + CHUNK + 2], dtype="u1")]
        yield ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)).astype("i4") & (BUCKETS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            total = sums.setdefault(lang, np.zeros(BUCKETS, dtype="i8"))
            for some in trigrams(text.as_py().encode("utf-8", "surrogatepass")):
                total += np.bincount(some, minlength=BUCKETS)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total], pa.list_(pa.int64()))], names=["lang", "counts"])


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [np.sum(np.stack(group["counts"].to_numpy()), axis=0)]})


def _fold(col: str) -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % FOLDS


def fit_texts(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram by language) from documents with a known ``lang``, all languages there are.

    To the driver come a count and one row of trigram counts per language, 256 KB each.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold("doc_id") != HELD_OUT))
    sizes = materialize(known.groupBy(F.col("lang").alias("_lang")).count(), "languages")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.join(sizes, F.col("lang") == F.col("_lang")).where(spot < F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * F.lit(float(1 << 30)))
    # The sample is bounded, so a few partitions hold it, each giving a row of counts per language.
    sample = chosen.select("lang", "text").repartition(8)
    rows = sample.mapInArrow(_counts, "lang string, counts array<bigint>").groupBy("lang").applyInPandas(_summed, "lang string, counts array<bigint>")
    counts = {r["lang"]: np.array(r["counts"], dtype="f8") for r in rows.collect()}
    languages = sorted(counts)
    if not languages:
        return ["und"], np.zeros((1, BUCKETS), dtype="f4")
    table = np.stack([counts[x] for x in languages]) + 0.5
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype("f4")


def log_likelihoods(table: np.ndarray):
    """Pandas UDF: text -> log likelihood by language, that of MOST_TRIGRAMS average trigrams where there are more."""
    k = len(table)

    def one(text: str | None) -> np.ndarray:
        total, n = np.zeros(k), 0
        for some in trigrams((text or "").encode("utf-8", "surrogatepass")) if text else ():
            total += table @ np.bincount(some, minlength=BUCKETS) if len(some) > BUCKETS // 4 else table[:, some].sum(axis=1, dtype="f8")
            n += len(some)
        return np.round(total * min(1.0, MOST_TRIGRAMS / max(1, n)), 6)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run


def declared_language(html: str) -> Column:
    """Primary subtag of the root element's lang attribute, lower-cased; null without one."""
    found = F.lower(F.regexp_extract(F.col(html), r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,8})""", 1))
    return F.when(found != "", found)


def visible_text(html: str) -> Column:
    """Text without scripts, styles, comments and tags; character references stay."""
    return F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_evidence(pages: DataFrame, *more: Column) -> DataFrame:
    """``page_id, number, host, domain, suffix, declared`` of every page, and ``more``; number is the first number of the path."""
    number = F.regexp_extract(path_of("url"), r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    rows = pages.select("page_id", F.when(number != "", number.cast("long")).alias("number"), host_of("url").alias("host"), declared_language("html").alias("declared"), *more)
    return rows.withColumns({"domain": domain_of("host"), "suffix": suffix_of("host")})


def _argmax(values: Column) -> Column:
    """Position from 0 of the largest entry, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _tallies(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*(F.sum((F.col("guess") == i).cast("double")) for i in range(k))).alias("tally"), F.count("*").alias("_n"))


def meet_tally(rows: DataFrame, tallies: DataFrame, by: str, name: str, k: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the tally of their value of ``by`` as ``name``; null where it is null.

    A table of tallies (written by the caller) that fits in ``limit`` bytes is broadcast. Of a larger one the most frequent values are, as many
    as fit; only rows of other values are dealt by value, and no such value is frequent. Rows that need no partner are spread by a hash of themselves.
    """
    fits = max(1, limit // (8 * k + 128))
    known = tallies.select(F.col(by).alias("_v"), F.col("tally").alias(name))
    if tallies.count() <= fits:
        return rows.join(F.broadcast(known), F.col(by) == F.col("_v"), "left").drop("_v")
    # A value with at least this many rows is one of fewer than ``fits``.
    often = rows.count() // fits + 1
    hot = tallies.where(F.col("_n") >= often).select(F.col(by).alias("_v"), F.col("tally").alias("_hot"))
    near = rows.join(F.broadcast(hot), F.col(by) == F.col("_v"), "left").drop("_v")
    key = F.when(F.col("_hot").isNull() & F.col(by).isNotNull(), F.concat(F.lit("v"), by)).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("string")))
    cold = tallies.where(F.col("_n") < often).select(F.concat(F.lit("v"), by).alias("_k"), F.col("tally").alias("_cold"))
    met = near.withColumn("_key", key).join(cold, F.col("_key") == F.col("_k"), "left")
    return met.withColumn(name, F.coalesce("_hot", "_cold")).drop("_key", "_k", "_hot", "_cold")


def fuse(units: DataFrame, languages: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Posterior over ``languages`` for ``units`` (any columns, with likelihood, host, domain, suffix, declared).

    Adds ``lang, confidence, text_lang``. ``guess`` is what the text alone says; the grouped counts of guesses by declaration,
    suffix, host and domain are the corpus's, each unit's own guess taken out again. Null evidence says nothing; a
    unit with no evidence has the corpus's most frequent language.
    """
    k = len(languages)
    names = F.array(*map(F.lit, languages))
    units = units.withColumn("guess", _argmax(F.col("likelihood")))
    all_rows = units.agg(*(F.sum((F.col("guess") == i).cast("double")) for i in range(k))).first()
    base = np.array([x or 0.0 for x in all_rows]) + PSEUDO
    base = base / base.sum()
    base_col = F.array(*(F.lit(float(x)) for x in base))

    def own(i: Column) -> Column:
        return (F.col("guess") == i).cast("double")

    def shrunk(tally: str, parent: Column) -> Column:
        """Counts without the unit's own guess, with the parent's shares as STRENGTH pseudo-counts, as shares."""
        n = F.aggregate(F.coalesce(F.col(tally), F.array(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        counted = F.zip_with(F.col(tally), parent, lambda c, p: c + STRENGTH * p)
        less = F.transform(counted, lambda x, i: F.greatest(x - own(i), F.lit(1e-9)) / (n - 1 + STRENGTH))
        return F.when(F.col(tally).isNull(), parent).otherwise(less)

    def evidence(tally: str) -> Column:
        """Log of how much more often than its share a language goes with this declaration or suffix."""
        n = F.aggregate(F.coalesce(F.col(tally), F.array(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        rates = F.zip_with(F.col(tally), base_col, lambda c, b: F.struct(c.alias("c"), b.alias("b")))
        logs = F.transform(rates, lambda x, i: F.log((F.greatest(x["c"] - own(i), F.lit(0.0)) + PSEUDO * x["b"]) / (n - 1 + PSEUDO) / x["b"]))
        return F.when(F.col(tally).isNull(), F.array_repeat(F.lit(0.0), k)).otherwise(logs)

    # Units without any of this evidence, often most of them, take no part in the joins.
    levels = ["host", "domain", "suffix", "declared"]
    some = F.col("host").isNotNull() | F.col("declared").isNotNull()
    spoken = told = units.where(some)
    for level in levels:
        tallies = materialize(_tallies(spoken.where(F.col(level).isNotNull()), level, k), f"tally-{level}")
        told = meet_tally(told, tallies, level, f"{level}_tally", k, limit)
    silent = units.where(~some)
    units = told.unionByName(silent.withColumns({f"{x}_tally": F.lit(None).cast("array<double>") for x in levels}))
    prior = shrunk("host_tally", F.col("domain_prior"))
    fused = units.withColumn("domain_prior", shrunk("domain_tally", base_col)).withColumn("host_prior", prior)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.transform(F.col("host_prior"), lambda p: F.log(p))
    score = plus(plus(F.col("likelihood"), logs), plus(evidence("declared_tally"), evidence("suffix_tally")))
    fused = fused.withColumn("score", score).withColumn("best", F.array_max("score"))
    confidence = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return fused.withColumns({"lang": F.element_at(names, _argmax(F.col("score")) + 1), "confidence": confidence, "text_lang": F.element_at(names, F.col("guess") + 1)})


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, host, declared, suffix, text_lang, lang, confidence``: a row per document, and one (doc_id null) for
    every page that is not the one of a document's row.

    A document's text speaks for it, with the page that shows it (the one of smallest page_id, if several) for
    markup and address; its other pages are rows with the same text's evidence and their own markup and address (of documents
    that repeat an id one speaks for them), so every page counts in the tallies. A page without document speaks by its
    own visible text. Null and empty texts say nothing, so the other evidence decides. Repeated rows and null ids come
    through each. Empty tables give no rows.
    """
    languages, table = fit_texts(docs)
    likelihood = log_likelihoods(table)
    empty = F.lit("")
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), likelihood(F.coalesce("text", empty)).alias("likelihood")), "likelihoods")
    shown = materialize(page_evidence(pages).where(F.col("number").isNotNull()).withColumn("at", F.monotonically_increasing_id()), "pages")
    first = shown.groupBy("number").agg(F.min(F.struct("page_id", "host", "domain", "suffix", "declared", "at")).alias("e"), F.count("*").alias("times"))
    with_page = texts.join(first, texts["doc_id"] == first["number"], "left").select("doc_id", "e.page_id", "e.host", "e.domain", "e.suffix", "e.declared", "likelihood")
    speaks = texts.select(F.col("doc_id").alias("number"), "likelihood").join(first.where("times > 1"), "number").groupBy("number").agg(F.min("likelihood").alias("likelihood"), F.min("e.at").alias("taken"))
    others = shown.join(speaks, "number").where("at <> taken").select(F.lit(None).cast("long").alias("doc_id"), "page_id", "host", "domain", "suffix", "declared", "likelihood")
    # Pages without document carry their own text, so no row has to be found again by an id that may repeat or be null.
    own = page_evidence(pages, visible_text("html").alias("text"))
    known = texts.select(F.col("doc_id").alias("number")).where(F.col("number").isNotNull()).distinct()
    loose = own.where(F.col("number").isNull()).unionByName(own.where(F.col("number").isNotNull()).join(known, "number", "left_anti"))
    alone = loose.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "host", "domain", "suffix", "declared", likelihood("text").alias("likelihood"))
    units = materialize(with_page.unionByName(others).unionByName(alone), "units")
    return fuse(units, languages).select("doc_id", "page_id", "host", "declared", "suffix", "text_lang", "lang", "confidence")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, with the evidence of a page that shows it, and of every other page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))
