"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies. Within a source the expectations are summed in a fixed order, one random
offset is added, and a copy leaves at each integer boundary that the running sum crosses.

Words, not documents, are to meet the target, so the longest documents of a source expect whole copies: one after the other, as many as bring the
words so far nearest to their share. What that leaves of the target is the expectation of all others. Whole expectations cross as many
boundaries whatever the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrajobs.functions.storage import drop, materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at this many times its size.
MOST = 3
#: Fixed-point steps in one copy, as a power of two.
BITS = 20
UNIT = 1 << BITS
#: Documents of a source that may expect whole copies.
LONGEST = 64
#: Sources up to which the table of one row a source (up to 2 KB) is broadcast; more meet their documents by sort-merge.
MOST_BROADCAST = 10_000


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows, one per document.

    The total of all sizes is shared by weight; what a source's cap of ``most`` times its size leaves
    over is shared again by weight among the others, until none is above its cap. Sources fill up in the order
    of cap over weight, so one pass over the sources in that order finds the level at which the shares balance.
    The windows see one row per source, all in one task: a million sources take it a few seconds.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = per_source.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    levels = ranked.select(
        "source", "source_size", "weight", "cap", "fill", F.row_number().over(order).alias("place"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
    )
    # The level that holds is the first in this order at which the next source is not filled; of sources that tie in fill
    # the later ones' levels count the earlier as full.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(everything)["level"]
    shared = levels.withColumn("balance", level)
    target = F.when(F.col("balance").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("balance")))
    return shared.select("source", "source_size", target.alias("target"))


def running_sum(rows: DataFrame, by: str, order: list[str], value: Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``value`` (long) over the rows before, in the order of ``order`` within ``by``.

    In two steps, so a source with a third of all rows is no single task: rows are dealt into ranges of (by, order), each range
    is summed per source, the sums of the ranges before give each its start (one row per range and source), and only then rows
    are summed within their range. The dealt rows are written, so that both steps see the same ranges.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_value", value.cast("long")).repartitionByRange(parts, F.col(by).asc_nulls_last(), *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "mix")
    sums = dealt.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_by", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    joined = summed.join(starts, summed[by].eqNullSafe(starts["_by"]) & (summed["_part"] == starts["_at"]))
    return joined.select(*rows.columns, "_value", (F.col("_start") + F.col("_within")).alias("_before"))


def _random(seed: int, by: str) -> Column:
    """A number of 0 to UNIT - 1 for each source."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(by).cast("string"), F.lit("")), F.col(by).isNull()), F.lit(UNIT))


def systematic_copies(rows: DataFrame, by: str, order: list[str], expected: Column, seed: int = 0, parts: int | None = None) -> DataFrame:
    """``rows`` with a column ``copies``: the integer boundaries that each row's expectation crosses.

    ``expected`` is a number of copies from 0 up, any for each row; null counts as 0. Sums are of fixed-point integers, so a
    rerun crosses the same boundaries.
    """
    steps = F.greatest(F.coalesce(F.round(expected * UNIT), F.lit(0)).cast("long"), F.lit(0))
    upto = F.col("_before") + _random(seed, by)
    crossed = F.shiftright(upto + F.col("_value"), BITS) - F.shiftright(upto, BITS)
    return running_sum(rows, by, order, steps, parts).withColumn("copies", crossed).drop("_value", "_before")


def _by_source(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row a source, to be broadcast where it is small, so that no source's documents are dealt to one task."""
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def plans(sizes: DataFrame, shares: DataFrame, order: list[str], most: float) -> DataFrame:
    """``shares`` with ``cut, whole, short_expected``: whole copies {row: n} of a source's longest documents, their least size, and what
    the others expect.

    Taken one after the other, each of the LONGEST longest gets the copies (0 to ``most``) that bring the words so far nearest to their share. What
    is then left must fit into the others, at 0 to ``most`` copies each; what does not, and half of the longest of them, may be missed. As
    many documents get whole copies as leave the least of that. A source has LONGEST + 1 rows here at most.
    """
    first = Window.partitionBy("source").orderBy(F.desc("size"), *order)
    longest = sizes.where("size > 0").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= LONGEST + 1)
    listed = longest.groupBy(F.col("source").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_nth", "size", "_row"))).alias("_listed"))
    joined = shares.join(listed, shares["_source"].eqNullSafe(listed["_s"]), "left").withColumn("_listed", F.coalesce("_listed", F.array().cast("array<struct<_nth:int,size:bigint,_row:bigint>>")))
    expected = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)

    def outcome(acc: Column, longest: Column) -> Column:
        """What may be missed if the documents so far have whole copies and the longest of the others is so long."""
        left, short = F.col("target") - acc["taken"], F.col("source_size") - acc["size"]
        missed = F.greatest(none, -left, left - float(most) * short) + longest / 2
        others = F.when(short > 0, F.greatest(none, F.least(F.lit(float(most)), left / short))).otherwise(none)
        return F.least(acc["best"], F.struct(missed.alias("missed"), F.size(acc["copies"]).alias("n"), others.alias("others")))

    def add(acc: Column, x: Column) -> Column:
        share = expected * (acc["size"] + x["size"]) - acc["taken"]
        copies = F.least(F.lit(int(most)), F.greatest(F.lit(0), F.floor(share / x["size"] + 0.5))).cast("long")
        return F.struct(
            F.concat(acc["copies"], F.array(copies)).alias("copies"), (acc["taken"] + copies * x["size"]).alias("taken"), (acc["size"] + x["size"]).alias("size"), outcome(acc, x["size"]).alias("best")
        )

    start = F.struct(
        F.array().cast("array<bigint>").alias("copies"), zero.alias("taken"), zero.alias("size"),
        F.struct(F.lit(float("inf")).alias("missed"), F.lit(0).alias("n"), none.alias("others")).alias("best"),
    )
    # Where the source has no more documents, all of them may have whole copies.
    end = lambda acc: F.when(F.size("_listed") <= LONGEST, F.struct(acc["copies"].alias("copies"), outcome(acc, zero).alias("best"))).otherwise(F.struct(acc["copies"].alias("copies"), acc["best"].alias("best")))
    done = joined.withColumn("_done", F.aggregate("_listed", start, add, end)).withColumn("_n", F.col("_done.best.n"))
    rows, copies = F.slice(F.col("_listed._row"), F.lit(1), F.col("_n")), F.slice(F.col("_done.copies"), F.lit(1), F.col("_n"))
    return done.select(
        "_source", "source_size", "target", F.get(F.col("_listed.size"), F.col("_n") - 1).alias("cut"), F.map_from_arrays(rows, copies).alias("whole"), F.col("_done.best.others").alias("short_expected")
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document.

    Documents of a source expect target over size copies each if they are long for it, and what then makes up the target if they
    are short, never above ``most``. A null text has size 0, a null source is a source of its own (last), a source
    without words has target 0 and copies 0; repeated rows are rows of their own. No rows give no rows.
    """
    sizes = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.monotonically_increasing_id().alias("_row"))
    return _mixed(sizes, ["doc_id", "_row"], weights, most, seed).drop("_row")


def _mixed(sizes: DataFrame, order: list[str], weights: tuple, most: float, seed: int) -> DataFrame:
    """``mix`` for rows with source, size and a number of their own, ``_row``, counted off from the longest, then in ``order``; other columns come through."""
    sizes = materialize(sizes, "sizes")  # words are counted once, not again for the ranges
    shares = targets(sizes.select("source", "size"), weights, most).withColumnRenamed("source", "_source")
    planned = materialize(plans(sizes, shares, order, most), "plans")
    rows = sizes.join(_by_source(planned, planned.count()), sizes["source"].eqNullSafe(planned["_source"]))
    whole = F.when(F.col("size") >= F.col("cut"), F.try_element_at("whole", F.col("_row")).cast("double"))
    told = rows.select(*sizes.columns, "source_size", "target", F.coalesce(whole, "short_expected").alias("expected"))
    out = systematic_copies(told, "source", [F.desc("size"), *order], F.col("expected"), seed)
    drop(sizes)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeat_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """The documents themselves, all columns, whatever these are called, each as often as the mix takes it.

    Rows are numbered and written first, so rows without doc_id or with the same one have copies of their own.
    """
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    numbered = materialize(docs.select(*(docs[c].alias(n) for c, n in own.items()), F.monotonically_increasing_id().alias("_row")), "numbered")
    text = own["text"]
    sizes = numbered.select("_row", F.col(own["doc_id"]).alias("doc_id"), F.col(own["source"]).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_text"))
    mixed = _mixed(sizes, ["doc_id", "_text", "_row"], weights, most, seed)
    taken = mixed.where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    copies = numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return copies.select(*(F.col(n).alias(c) for c, n in own.items()))
