"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table ``(digest, keep_id, group_size, batch)``, clustered by digest into buckets and sorted within them. Each
batch adds a row per distinct text of its own: the first row of a digest names what stays, the sizes of all its rows add
up. New digests are dealt into as many partitions as the index has buckets, so the sort-merge anti-join that finds unseen texts reads
the index without a shuffle, and without a sort while a bucket is one file. Everything is DataFrame or SQL functions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrajobs.functions.columns import rows_that
from terrajobs.functions.storage import fresh_path, materialize

#: Buckets of a new index at least; it has no fewer than the session's shuffle partitions. A bucket holds 1/buckets of the
#: distinct digests (about 50 bytes each), so an index of 10^10 digests wants some 4,000.
BUCKETS = 16
#: Ids and digests of wholly repeated rows up to which these are broadcast (100 bytes each).
MOST_BROADCAST = 100_000


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def open_index(spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """Create the index table, or register the one whose files are already at ``path``. Returns its name."""
    name = name or f"digest_index_{uuid.uuid4().hex}"
    path = path or fresh_path(spark, "digest-index")
    buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return name


def close_index(spark: SparkSession, index: str) -> None:
    """Forget the table's name; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {index}")


def _buckets(spark: SparkSession, index: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {index}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark takes the order within a bucket of one file as given. Jobs must end within."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row, written to the shared folder: the texts are read and hashed once."""
    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest")), "digests")


def unseen(groups: DataFrame, index: str, batch: int) -> DataFrame:
    """Rows of ``groups`` (digest, ...) whose digest no earlier batch of the index holds: the sort-merge anti-join."""
    spark = groups.sparkSession
    known = spark.table(index).where(F.col("batch") < batch).select("digest")
    return groups.repartition(_buckets(spark, index), "digest").hint("merge").join(known, "digest", "left_anti")


def totals(spark: SparkSession, index: str, batch: int) -> DataFrame:
    """``digest, keep_id, group_size`` of all texts of the index up to a batch: the earliest row stays, sizes add up."""
    rows = spark.table(index).where(F.col("batch") <= batch)
    return rows.groupBy("digest").agg(F.min_by("keep_id", "batch").alias("keep_id"), F.sum("group_size").alias("group_size"))


def append_batch(spark: SparkSession, index: str, hashed: DataFrame, batch: int | None = None) -> int:
    """Add ``(doc_id, digest)`` rows to the index as a batch; returns its number (the next one, unless given).

    Of equal texts of the batch the row with the largest doc_id is the one that may stay, null ids counting as smallest. Texts that
    earlier batches hold add to the size alone. A batch that is added again under its number adds nothing: what of it is there already is
    left out, so a job that died while it wrote can be run again.
    """
    last = spark.table(index).agg(F.max("batch")).first()[0]
    batch = (0 if last is None else last + 1) if batch is None else batch
    # Partial sums leave a row per digest and task before anything is dealt by digest.
    groups = materialize(hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
    with _sorted_buckets(spark):
        fresh = materialize(unseen(groups, index, batch).select("digest"), "unseen")
        # Texts seen before name no row of theirs.
        rows = groups.join(fresh.withColumn("_new", F.lit(True)), "digest", "left").select(
            "digest", F.when(F.col("_new"), F.col("keep_id")).alias("keep_id"), "group_size", F.lit(batch).cast("long").alias("batch")
        )
        if last is not None and batch <= last:
            there = spark.table(index).where(F.col("batch") == batch).select("digest")
            rows = rows.join(there, "digest", "left_anti")
        rows = materialize(rows, "new-rows")
    rows.repartition(_buckets(spark, index), "digest").sortWithinPartitions("digest").write.insertInto(index)
    return batch


def standing(spark: SparkSession, index: str, hashed: DataFrame, batch: int) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` of rows that are in the index up to ``batch``.

    Rows that share the id and the text of the row that stays all carry ``kept``. Totals are a row per digest; the join that gives
    each row its text's answer is an ordinary sort-merge join, whose hot digests AQE splits.
    """
    answers = materialize(totals(spark, index, batch), "digest-totals")
    return hashed.join(answers, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def add_batch(spark: SparkSession, index: str, hashed: DataFrame, batch: int | None = None) -> DataFrame:
    """Deduplicate ``(doc_id, digest)`` rows within themselves and against the index, and add them to it.

    Returns one row per input row: ``doc_id, digest, keep_id, group_size, kept``. Of equal texts of the
    batch the row with the largest doc_id stays (null ids count as smallest; rows that share the id and the text
    all carry ``kept``). A text that an earlier batch holds keeps that batch's row, so none of this batch stays (unless one is that very
    row), and its group_size counts all batches so far. Added again under its number, a batch has the same answers. No rows give no rows.
    """
    return standing(spark, index, hashed, append_batch(spark, index, hashed, batch))


def compact(spark: SparkSession, index: str, name: str | None = None, path: str | None = None) -> str:
    """A new index with the same texts in one batch, numbered as the last, and one file a bucket; the old one stays as it is.

    Every batch adds a file to each bucket, and a bucket of several files has to be sorted when it is read. No shuffle: buckets
    are summed where they are.
    """
    last = spark.table(index).agg(F.max("batch")).first()[0]
    buckets = _buckets(spark, index)
    new = open_index(spark, name, path, buckets)
    if last is not None:
        rows = totals(spark, index, last).repartition(buckets, "digest").withColumn("batch", F.lit(last).cast("long"))
        rows.sortWithinPartitions("digest").write.insertInto(new)
    return new


def deduplicate(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text", once: bool = False, batch: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is new to the index and to the batch.

    A row with a null id that stays is found by its null id and digest, as any other; rows that repeat the
    staying row's id and text come through once for each repetition, or with ``once`` the least of them alone (all columns
    must have an order).
    """
    spark = docs.sparkSession
    hashed = digests(docs, id_col, text_col)
    batch = append_batch(spark, index, hashed, batch)
    # Of texts that an earlier batch holds none stays, so those that this batch named are what is left.
    named = spark.table(index).where(F.col("batch") < batch).select("digest")
    decided = standing(spark, index, hashed, batch).where("kept")
    if batch > 0:
        decided = decided.join(named, "digest", "left_anti")
    stay = materialize(decided.groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "stay")
    at = [docs[id_col].cast("long"), text_digest(text_col)]
    if not once:
        return rows_that(docs, at, stay, ["doc_id", "digest"])
    single = rows_that(docs, at, stay.where("times = 1"), ["doc_id", "digest"])
    several = stay.where("times > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    n = several.count()
    if not n:
        return single
    # Few rows are wholly repeated, as a rule: then the texts need not be dealt again to find them.
    several = F.broadcast(several) if n <= MOST_BROADCAST else several
    own = docs.select(*(docs[c].alias(f"_own{i}") for i, c in enumerate(docs.columns)), *(e.alias(f"_on{i}") for i, e in enumerate(at)))
    met = own.join(several, F.col("_on0").eqNullSafe(F.col("_id")) & (F.col("_on1") == F.col("_digest"))).groupBy("_id", "_digest")
    least = met.agg(F.min(F.struct(*(f"_own{i}" for i in range(len(docs.columns))))).alias("_least"))
    return single.union(least.select(*(F.col(f"_least._own{i}").alias(c) for i, c in enumerate(docs.columns))))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays for its text, the group's size and the digest.

    The documents come in two batches, as new data does: the upper half of the ids first, so that of equal texts the largest id
    stays, then the lower half (and null ids) against the index of the first.
    """
    hashed = digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ends = hashed.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = open_index(spark)
    middle = 0 if ends[0] is None else (ends[0] + ends[1]) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    append_batch(spark, index, hashed.where(upper), 0)
    append_batch(spark, index, hashed.where(~upper), 1)
    out = standing(spark, index, hashed, 1)
    close_index(spark, index)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
