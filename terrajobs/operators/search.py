"""Search of texts by their words: an inverted index with weights, in which only the rarest words are join keys.

Words weigh the more the fewer entries have them. How alike two texts are is twice the weight of the words that both have over the weight of all words of
both; words that no entry has say nothing and do not count. Two texts that are alike enough share a word among the rarest of each (else what they
share would weigh too little), so both are filed under these alone, and a pair that meets under several counts under the first. Nothing is lost, and a
word that is everywhere, as "via", is no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrajobs.functions.storage import materialize
from terrajobs.functions.text import simple_name

#: How alike texts have to be, unless another number is given.
LEAST = 0.7
#: Steps of weight in one unit of the logarithm.
UNIT = 1000


def text_words(text: Column) -> Column:
    """The distinct words of a text, in order of letters: lower case, without accents and punctuation."""
    return F.array_sort(F.array_distinct(F.filter(F.split(simple_name(text), r"\s+"), lambda w: w != "")))


def word_weights(sets: DataFrame, words: str = "words") -> DataFrame:
    """``word, n, weight`` of every word: in how many sets it is, and round(UNIT * ln(1 + sets / n))."""
    total = sets.count()
    counts = sets.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.round(UNIT * F.log(1 + F.lit(float(total)) / F.col("n"))).cast("long"))


def _filed(sets: DataFrame, weights: DataFrame, name: str, least: float) -> DataFrame:
    """``words`` as ``name``, its known words in order of rarity, their weight, and a row for each of the rarest that have to be looked under."""
    known = sets.select("words", F.explode("words").alias("word")).join(weights, "word").groupBy(F.col("words").alias(name))
    rows = known.agg(F.sort_array(F.collect_list(F.struct("n", "word", "weight"))).alias("items"), F.sum("weight").alias("total")).where("total > 0")
    # Two texts alike enough share words of this part of the weight of each at least.
    share = least / (2 - least) - 1e-9
    start = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<string>").alias("under"))

    def add(acc: Column, x: Column) -> Column:
        rare = F.col("total") - acc["before"] >= F.col("total") * share
        return F.struct((acc["before"] + x["weight"]).alias("before"), F.when(rare, F.concat(acc["under"], F.array(x["word"]))).otherwise(acc["under"]).alias("under"))

    rows = rows.withColumn("under", F.aggregate("items", start, add)["under"])
    return rows.select(name, F.col("items").alias(f"{name}_items"), F.col("total").alias(f"{name}_total"), F.explode("under").alias("word"))


def search(asked: DataFrame, text: str, entries: DataFrame, entry: str, value: Column, least: float = LEAST) -> DataFrame:
    """``text, value, score``: of each distinct text the entry most like it, if it is so by ``least`` (above 0, up to 1).

    Of entries that are as much alike the one of least ``value`` is taken. Null texts, and texts without a word that the entries know, find nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("texts are alike by more than 0, up to 1")
    queries = asked.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("words", text_words(F.col("text")))
    queries = materialize(queries, "queries")
    known = materialize(entries.select(text_words(F.col(entry)).alias("words"), value.alias("value")).where("size(words) > 0").groupBy("words").agg(F.min("value").alias("value")), "entries")
    weights = materialize(word_weights(known), "weights")
    left = _filed(queries.select("words").distinct(), weights, "q", least)
    right = _filed(known, weights, "e", least)
    shared = F.array_intersect(F.transform("q_items", lambda i: i["word"]), F.transform("e_items", lambda i: i["word"]))
    met = left.join(right, "word").withColumn("both", shared).where(F.col("word") == F.col("both")[0])
    weight = F.aggregate(F.filter("q_items", lambda i: F.array_contains("both", i["word"])), F.lit(0).cast("long"), lambda acc, i: acc + i["weight"])
    scored = met.select("q", "e", (2 * weight / (F.col("q_total") + F.col("e_total"))).alias("score")).where(F.col("score") >= least)
    valued = scored.join(known, F.col("e") == F.col("words")).groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("less"), "value")).alias("best"))
    return queries.join(valued, F.col("words") == F.col("q")).select(F.col("text").alias(text), F.col("best.value").alias("value"), (-F.col("best.less")).alias("score"))


def holders(asked: DataFrame, text: str, entries: DataFrame, entry: str) -> DataFrame:
    """``text`` with all columns of the entries whose ``entry`` holds its words, next to each other and in this order.

    A text is looked up under its rarest word alone; one with a word that no entry has is held by none. Null and empty texts are held by none.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.trim(simple_name(c)), r"\s+", " "), F.lit(" "))
    queries = materialize(asked.select(F.col(text).alias("_text")).distinct().select("_text", spaced(F.col("_text")).alias("_asked"), text_words(F.col("_text")).alias("_words")).where("size(_words) > 0"), "queries")
    rows = materialize(entries.withColumns({"_said": spaced(F.col(entry)), "words": text_words(F.col(entry))}), "entries")
    counts = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # A word that nobody has counts as the rarest, and nothing is filed under it.
    each = queries.select("_text", "_asked", F.explode("_words").alias("word")).join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = each.groupBy("_text", "_asked").agg(F.min(F.struct("n", "word"))["word"].alias("_under"))
    filed = rows.withColumn("_word", F.explode("words"))
    met = rarest.join(filed, F.col("_under") == F.col("_word")).where(F.col("_said").contains(F.col("_asked")))
    return met.select(F.col("_text").alias(text), *entries.columns)
