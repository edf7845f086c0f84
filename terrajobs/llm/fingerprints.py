"""Document fingerprints by weighted SimHash, and permuted block tables that find those nearby.

Terms are words with the word that follows. Each term's hash votes on 64 bits, weighted by the term's length and as often as
it occurs; a bit is set where the votes for it are over half. Everything is DataFrame functions: terms are
exploded, and an aggregate of 32 sums a document, each carrying the votes of two bits, is combined before the shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrajobs.functions.storage import materialize

#: Stands for a null doc_id: one document, ordered first.
NULL_ID = -(1 << 63)
#: Most that the length of a term counts.
MOST_WEIGHT = 16
#: Bits by which fingerprints may differ in a search, and the blocks that they are cut into.
RADIUS, BLOCKS = 3, 5
#: Fingerprints of documents whose id this divides are searched for among all.
QUERY_EVERY = 20
_BLANKS = " \t\n\x0b\x0c\r"


def terms(text: Column) -> Column:
    """Array of (word, next word or null): ASCII white space parts words. A text without words has one empty term."""
    words = F.split(F.btrim(text, F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def fingerprint(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, fp``: the fingerprint of each group of ``keys``, whose rows have one text. Null counts as empty; no words: 0.

    Sum i holds the votes of bit i in its lower and of bit i + 32 in its upper half: votes stay below 2**31
    up to texts of a billion characters.
    """
    exploded = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    first, second = F.col("term")["a"], F.col("term")["b"]
    weight = F.least(F.length(first) + F.coalesce(F.length(second), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long")
    voting = exploded.select(*keys, F.xxhash64(first, second).alias("h"), weight.alias("w"))
    both = F.lit((1 << 32) + 1).cast("long")
    votes = voting.groupBy(*keys).agg(F.sum("w").alias("all"), *(F.sum(F.col("w") * F.shiftrightunsigned("h", i).bitwiseAND(both)).alias(f"v{i}") for i in range(32)))
    low = lambda i: F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = lambda i: F.shiftrightunsigned(F.col(f"v{i}"), 32)
    bit = lambda n, i: F.when(n * 2 > F.col("all"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    fp = F.lit(0).cast("long")
    for i in range(32):
        fp = fp.bitwiseOR(bit(low(i), i)).bitwiseOR(bit(high(i), i + 32))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One mask per table. ``radius`` differing bits touch that many blocks at most, so some choice of the other
    ``blocks - radius`` is untouched; a table is such a choice, moved to the front and compared whole."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("more blocks than the radius are needed, 64 at most")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def search(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query, fp, distance``: all ``fp`` of ``fps`` within ``radius`` bits of each ``query`` of ``queries``, each once.

    Both sides are made distinct first, so copies meet as one. A row goes to every table under its masked bits; what meets
    there is verified, and reported by the first of the tables that it meets in.
    """
    masks = block_masks(radius, blocks)

    def tabled(df: DataFrame, name: str) -> DataFrame:
        entry = F.explode(F.array(*(F.struct(F.lit(k).alias("table"), F.col(name).bitwiseAND(_long(m)).alias("front")) for k, m in enumerate(masks))))
        return df.select(name).where(F.col(name).isNotNull()).distinct().select(name, entry.alias("e")).select(name, "e.table", "e.front")

    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first_table = F.coalesce(*(F.when(differ.bitwiseAND(_long(m)) == 0, F.lit(k)) for k, m in enumerate(masks)))
    left, right = tabled(queries, "query"), tabled(fps, "fp")
    met = (left["table"] == right["table"]) & (left["front"] == right["front"]) & (F.bit_count(differ) <= radius) & (left["table"] == first_table)
    return left.join(right, met).select("query", "fp", F.bit_count(differ).alias("distance"))


def _ring(rows: DataFrame) -> DataFrame:
    """``doc, text_key, next_doc, next_key``: the row that follows each, by doc and then text_key; the first after the last.

    Ranges of rows are pinned in the shared folder; within one the next row is a window's, and the last of a range takes
    the first of the next range, from a table of one row per range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("doc", "text_key").distinct().repartitionByRange(parts, "doc", "text_key")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ring")
    row = F.struct("doc", "text_key")
    heads = ranged.groupBy("part").agg(F.min(row).alias("head"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per range
    following = F.coalesce(F.lead("head").over(in_order), F.first("head").over(in_order))
    heads = heads.select("part", following.alias("after"))
    inside = F.lead(row).over(Window.partitionBy("part").orderBy("doc", "text_key"))
    follows = F.coalesce(F.col("inside"), F.col("after"))
    # One row per range: as small as the number of partitions.
    return ranged.withColumn("inside", inside).join(F.broadcast(heads), "part").select(
        "doc", "text_key", follows["doc"].alias("next_doc"), follows["text_key"].alias("next_key")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n_chars, edited_sha256, fp, edited_fp, next_fp`` of every row.

    A text's edited form has its last half, floor(n_chars / 2) code points, replaced by as many of the first of
    the next document's (or all). Null counts as empty. Rows are told apart by doc_id and xxhash64 of the text: documents follow each
    other by doc_id, rows of one doc_id by that hash, and rows equal in both get a row each with the same values.
    A null doc_id comes first. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    small = materialize(rows.select("doc", "text_key", F.length("text").cast("long").alias("n_chars")), "rows")
    ring = materialize(_ring(small), "next")
    wanted = small.distinct().join(ring, ["doc", "text_key"]).select(
        F.col("doc").alias("of_doc"), F.col("text_key").alias("of_key"), "n_chars", F.col("next_doc").alias("doc"), F.col("next_key").alias("text_key")
    )
    whole = rows.dropDuplicates(["doc", "text_key"]) if small.count() != ring.count() else rows
    half = F.floor(F.col("n_chars") / 2).cast("int")
    heads = whole.join(wanted, ["doc", "text_key"]).select(
        F.col("of_doc").alias("doc"), F.col("of_key").alias("text_key"), "n_chars", F.substring("text", F.lit(1), half).alias("head")
    )
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), "head")
    both = whole.join(heads, ["doc", "text_key"]).select("doc", "text_key", "n_chars", "text", edited.alias("edited"))
    forms = both.select(
        "doc", "text_key", "n_chars",
        F.explode(F.array(F.struct(F.lit("").alias("sha"), F.col("text").alias("form")), F.struct(F.sha2("edited", 256).alias("sha"), F.col("edited").alias("form")))).alias("x"),
    ).select("doc", "text_key", "n_chars", "x.sha", "x.form")
    marked = materialize(fingerprint(forms, ["doc", "text_key", "n_chars", "sha"], "form"), "fingerprints")
    own = marked.where("sha = ''").select("doc", "text_key", "n_chars", "fp")
    changed = marked.where("sha <> ''").select("doc", "text_key", F.col("sha").alias("edited_sha256"), F.col("fp").alias("edited_fp"))
    following = own.select(F.col("doc").alias("next_doc"), F.col("text_key").alias("next_key"), F.col("fp").alias("next_fp"))
    out = own.join(changed, ["doc", "text_key"]).join(ring, ["doc", "text_key"]).join(following, ["next_doc", "next_key"])
    return small.select("doc", "text_key").join(out, ["doc", "text_key"]).select("doc", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def hex64(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, their likeness, and, for every document whose id is divisible
    by 20, how many documents the block tables find within 3 bits of it (itself included)."""
    marked = materialize(edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "edited")
    classes = marked.groupBy("fp").agg(F.count("*").alias("docs"))
    asks = F.coalesce(F.col("doc") % QUERY_EVERY == 0, F.lit(False))
    asked = marked.where(asks)
    found = search(asked.select(F.col("fp").alias("query")), classes).join(classes, "fp").groupBy(F.col("query").alias("fp")).agg(F.sum("docs").alias("n_within"))
    # Rows that ask nothing, most of them, stay out of the join.
    out = asked.join(found, "fp").unionByName(marked.where(~asks).withColumn("n_within", F.lit(None).cast("long")))
    return out.select(
        F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"),
        hex64("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_within",
    )
