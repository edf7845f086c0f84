"""How far the sources of a language lie from each other, by the terms that they use.

The terms that a language keeps are dealt into segments by hash, a few thousand to each. In a segment every group (a source of the language)
is a segment tree over the term ids, frequent terms first: a leaf is a count, an inner node the pair of its halves. Nodes are hash-consed, so
equal stretches of counts, the empty tails of small groups above all, are one node whatever groups have them. Two groups are
compared by walking both trees at once, from the roots; a pair of nodes that is met again is priced once. The prices of a pair's
segments add up. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrajobs.functions.storage import drop, materialize

#: Documents of the language in which a term is kept, and ranks of a group's terms that are told.
LEAST_DOCS, MOST_TERMS = 3, 200
#: Scale of shares.
UNIT = 1_000_000_000
#: Terms in a segment on the average, and groups whose pairs one task compares.
SEGMENT, GROUPS_A_BLOCK = 4096, 256
#: Distinct (group, term) that a task counts before it hands them on.
HELD = 300_000
#: A term is a run of other bytes than these: ASCII letters, and the bytes of all characters beyond ASCII.
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOC = 1 << 40


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, ASCII letters in lower case."""
    return text.translate(_SPACED).split()


def tally(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of terms, added up in part; each group also has rows without term.

    Counts that a task holds are handed on before they grow beyond HELD, so memory does not grow with the vocabulary.
    """

    def handed(counts: dict):
        for (lang, source), of in counts.items():
            words, both = [None, *of.keys()], np.array([0, *of.values()], np.int64)
            columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(both % _DOC), pa.array(both // _DOC)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(v, pa.string()), len(words)) for v in (lang, source)] + columns, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                of = counts.setdefault((lang, source), {})
                held -= len(of)
                for term, n in Counter(terms(text)).items():
                    of[term] = of.get(term, 0) + n + _DOC
                held += len(of)
                if held > HELD:
                    yield from handed(counts)
                    counts, held = {}, 0
        yield from handed(counts)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, total, first``: the counts of every kept term in every source that has it, its total in the language, and whether
    the row is the first of its term; each group also has a row without term.

    Rows are dealt by language and term once; sums by source and those by term need no further shuffle.
    """
    dealt = tally(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = dealt.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return told.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def group_table(kept: DataFrame) -> DataFrame:
    """``lang, source, n_group, n_lang, v, n_segments, block, n_blocks`` of every group, also of those without terms."""
    there = F.col("term").isNotNull()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if(there & F.col("first")).alias("_firsts"))
    lang, named = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    told = sums.select("lang", "source", "n_group", F.sum("n_group").over(lang).alias("n_lang"), F.sum("_firsts").over(lang).alias("v"), F.floor((F.row_number().over(named) - 1) / GROUPS_A_BLOCK).cast("int").alias("block"))
    return told.withColumns({"n_segments": F.greatest(F.lit(1), F.ceil(F.col("v") / SEGMENT)).cast("long"), "n_blocks": F.max("block").over(lang) + 1})


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), in whole numbers also where UNIT * n does not fit in 64 bits."""
    wide, n, total = (lambda c: c.cast("decimal(19,0)")), n + 1, total + v
    return 1 + F.when(n < 9 * UNIT, F.call_function("div", UNIT * n, total)).otherwise(F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n), wide(total)))


def telling_terms(kept: DataFrame, groups: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``lang, source, item, value, rank``: the terms of which a group has a larger share than its language, by distance."""
    met = kept.where("term IS NOT NULL AND n > 0").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    more = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    priced = more.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(root of each tree, levels from the top): trees over rows of leaf numbers, a power of two wide. A level is (left, right) of its nodes.

    Equal pairs of halves are one node, in whatever tree and place.
    """
    nodes, levels = leaves, []
    while nodes.shape[1] > 1:
        left, right = nodes[:, ::2], nodes[:, 1::2]
        width = int(nodes.max()) + 1
        pairs, here = np.unique(left * width + right, return_inverse=True)
        levels.append((pairs // width, pairs % width))
        nodes = here.reshape(left.shape)
    return nodes[:, 0], levels[::-1]


def walk(a: int, b: int, levels: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(leaf of a, leaf of b, the ways down): the distinct pairs of leaves that two trees have in one place.

    A level's pairs of nodes are those of the level above, taken apart, each once; a way down tells for every left half and then every right
    half which of the pairs below it is.
    """
    x, y, down = np.array([a]), np.array([b]), []
    for left, right in levels:
        x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
        width = int(y.max()) + 1
        pairs, here = np.unique(x * width + y, return_inverse=True)
        x, y = pairs // width, pairs % width
        down.append(here)
    return x, y, down


def priced(leaf_prices: np.ndarray, down: list[np.ndarray]) -> int:
    """The price of the roots: a pair of nodes costs what its halves cost."""
    for here in reversed(down):
        half = len(here) // 2
        leaf_prices = leaf_prices[here[:half]] + leaf_prices[here[half:]]
    return int(leaf_prices[0])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """As ``share``, of several counts."""
    if len(counts) and int(counts.max()) >= 9 * UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // total for c in counts], np.int64)
    return 1 + UNIT * (counts + 1) // total


def compare(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """``lang, a, b, price`` of all ordered pairs of groups of one segment and pair of blocks.

    ``rows`` (source, term, n, total) are its counts; ``groups`` (source, n_group, v, block, i, j, in_segment) all its groups, also those that have
    none of the terms.
    """
    names = groups.column("source").to_pylist()
    if not names:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "price": pa.array([], pa.int64())})
    lang, v, m = (groups.column(c)[0].as_py() for c in ("lang", "v", "in_segment"))
    i, j = groups.column("i")[0].as_py(), groups.column("j")[0].as_py()
    counts = np.zeros((len(names), m), np.int64)
    if len(rows):
        order = rows.group_by("term").aggregate([("total", "max")]).sort_by([("total_max", "descending"), ("term", "ascending")]).column("term")
        slot = pc.index_in(rows.column("term"), value_set=order.combine_chunks()).to_numpy()
        counts[pc.index_in(rows.column("source"), value_set=pa.array(names)).to_numpy(), slot] = rows.column("n").to_numpy()
    values, leaf = np.unique(counts, return_inverse=True)
    # Places after the last term hold a leaf of their own, which costs nothing.
    nothing = len(values)
    leaves = np.full((len(names), 1 << max(0, m - 1).bit_length()), nothing, np.int64)
    leaves[:, :m] = leaf.reshape(counts.shape)
    roots, levels = consed(leaves)
    p = [np.append(shares(values, n + v), 1) if m else np.ones(1, np.int64) for n in groups.column("n_group").to_pylist()]
    block = groups.column("block").to_pylist()
    of = lambda k: [g for g in range(len(names)) if block[g] == k]
    out = []
    for a, b in combinations(of(i), 2) if i == j else product(of(i), of(j)):
        x, y, down = walk(int(roots[a]), int(roots[b]), levels)
        pa_, pb = p[a][x], p[b][y]
        gap = np.where(x == nothing, 0, (pa_ - pb) * (pa_ - pb))
        out += [(names[a], names[b], priced(gap // pb, down)), (names[b], names[a], priced(gap // pa_, down))]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array([r[0] for r in out], pa.string()), "b": pa.array([r[1] for r in out], pa.string()), "price": pa.array([r[2] for r in out], pa.int64())})


def distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: the other sources of a group's language by distance."""
    counts = kept.where("term IS NOT NULL").join(groups.select("lang", "source", "n_segments", "block", "n_blocks"), ["lang", "source"])
    counts = counts.withColumn("segment", F.pmod(F.xxhash64("term"), F.col("n_segments")))
    sizes = counts.where("first").groupBy("lang", "segment").agg(F.count("*").alias("in_segment"))
    everywhere = groups.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_segments") - 1))).join(sizes, ["lang", "segment"], "left").withColumn("in_segment", F.coalesce("in_segment", F.lit(0)))
    # With few groups there is one block and one pair of blocks; a group goes to every pair that its block is of.
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))))
    both = [df.withColumn("_at", pairs).select(*columns, "_at.i", "_at.j") for df, columns in ((counts, ["lang", "segment", "source", "term", "n", "total"]), (everywhere, ["lang", "segment", "source", "n_group", "v", "block", "in_segment"]))]
    by = ["lang", "segment", "i", "j"]
    met = both[0].groupBy(*by).cogroup(both[1].groupBy(*by)).applyInArrow(compare, "lang string, a string, b string, price long")
    sums = met.groupBy("lang", "a", "b").agg(F.sum("price").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` from ``lang, source, text``: part ``pair``, the other sources of the language, and part ``term``.

    Null lang, source and text count as empty; a language without kept terms has pairs of value 0; one source alone has no pairs; repeated rows count
    as documents of their own; no rows give no rows. Other columns are not looked at.
    """
    kept = materialize(kept_terms(docs, least), "terms")
    groups = materialize(group_table(kept), "groups")
    pairs = materialize(distances(kept, groups), "pairs")
    told = materialize(telling_terms(kept, groups, most), "telling")
    drop(kept)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(told, "term"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of ``documents`` within each language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
g AS (SELECT a.lang, a.source, coalesce(b.n, 0) AS n_group FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) b ON a.lang = b.lang AND a.source = b.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n_group + l.v) AS BIGINT) AS p, 1 + CAST(CAST({UNIT} AS HUGEINT) * (k.total + 1) // (l.n_lang + l.v) AS BIGINT) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
          ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
