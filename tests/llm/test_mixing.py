import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from terrajobs.llm import mixing as op

from .common import AWKWARD, SMALL, awkward


def brute_targets(sizes):
    """Share out by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest / total > op.MOST * sizes[s]}
        if not over:
            target |= {s: weight[s] * rest / total for s in open_}
            break
        for s in over:
            target[s] = float(op.MOST * sizes[s])
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def sizes_of(rows):
    return [len([w for w in (r[1] or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]) for r in rows]


def test_targets_and_sizes(spark):
    sources = defaultdict(int)
    for r, n in zip(AWKWARD, sizes_of(AWKWARD)):
        sources[r[3]] += n
    want = brute_targets(sources)
    rows = op.mix(awkward(spark)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r[0], r[3], n) for r, n in zip(AWKWARD, sizes_of(AWKWARD)))
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sources[r["source"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= op.MOST


def test_many_shapes_of_sources(spark):
    for sizes in ({"a": 10, "b": 1, "c": 1000}, {"a": 0, "b": 0}, {"b": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 2}, {"x": 7, "y": 0, "z": 3}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in op.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_sources_that_tie(spark):
    """Equal sizes and weights, and sizes in proportion to the weights: the whole total is shared."""
    for sizes in ({x: 100 for x in "abcd"}, {x: 100 for x in "abcdefgh"}, {"a": 50, "b": 20, "c": 10, "d": 50, "e": 20}, {"a": 1, "b": 7, "c": 900, "d": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in op.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * want[s] for s in sizes), (sizes, got, want)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def brute_taken(rows, targets, offsets):
    """{row number: copies} of (doc_id, source, size) rows: whole copies of the longest, then one running sum with the source's offset."""
    out = {}
    for source, target in targets.items():
        mine = sorted(((-size, doc_id, i) for i, (doc_id, s, size) in enumerate(rows) if s == source))
        sizes = [-m[0] for m in mine]
        total = sum(sizes)
        worded = sum(n > 0 for n in sizes)
        expected = target / total if total else 0.0
        whole, taken, seen, plans = [], 0, 0, []
        for k in range(min(worded, op.LONGEST) + 1):
            left, short, longest = target - taken, total - seen, sizes[k] if k < worded else 0
            plans.append((max(0.0, -left, left - op.MOST * short) + longest / 2, k, max(0.0, min(float(op.MOST), left / short)) if short > 0 else 0.0))
            if k < worded:
                whole.append(min(op.MOST, max(0, math.floor((expected * (seen + sizes[k]) - taken) / sizes[k] + 0.5))))
                taken, seen = taken + whole[k] * sizes[k], seen + sizes[k]
        _, n, others = min(plans)
        upto = offsets[source]
        for k, (_, _, i) in enumerate(mine):
            step = math.floor((whole[k] if k < n else others) * op.UNIT + 0.5)
            out[i] = (upto + step) // op.UNIT - upto // op.UNIT
            upto += step
    return out


def test_query_equals_brute_force(spark):
    """The rows of the query at two sizes, from sizes and targets by the definition of the method."""
    for folder in (SMALL, "/root/testdata/sf0.01"):
        docs = [(r["doc_id"], r["source"], n) for r, n in ((r, sizes_of([(0, r["text"])])[0]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())]
        rows = {r["doc_id"]: r for r in op.op7_mix_sources(spark, folder).collect()}
        targets = {s: rows[i]["target"] for i, s, _ in docs}
        named = spark.createDataFrame([(s,) for s in targets], "source string")
        offsets = {r[0]: r[1] for r in named.select("source", op._random(0, "source")).collect()}
        want = brute_taken(docs, targets, offsets)
        assert len(rows) == len(docs) and [rows[d[0]]["copies"] for d in docs] == [want[i] for i in range(len(docs))]
        assert all(rows[i]["size"] == n and rows[i]["taken"] == rows[i]["copies"] * n for i, _, n in docs)


def test_query_comes_near_its_targets_and_agrees_with_itself(spark):
    a, b = (sorted(map(tuple, op.op7_mix_sources(spark, SMALL).collect())) for _ in range(2))
    assert a == b and len(a) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    taken = op.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] for r in taken)


def test_boundaries_crossed(spark):
    """Copies of each row by the definition, over ranges that cut the sources."""
    rows = [("s" if i % 3 else "t", i, (i * 37 % 300) / 100) for i in range(200)] + [("s", 500, None), (None, 501, 1.5), (None, 502, 1.5)]
    df = spark.createDataFrame(rows, "source string, n long, e double")
    got = {r["n"]: r["copies"] for r in op.systematic_copies(df, "source", ["n"], F.col("e"), seed=3, parts=7).collect()}
    again = {r["n"]: r["copies"] for r in op.systematic_copies(df, "source", ["n"], F.col("e"), seed=3, parts=2).collect()}
    assert got == again
    for source in ("s", "t", None):
        mine = sorted((n, e or 0) for s, n, e in rows if s == source)
        assert abs(sum(got[n] for n, _ in mine) - sum(e for _, e in mine)) <= 1
        assert all(int(e) <= got[n] <= int(e) + 1 for n, e in mine)


def test_documents_repeat(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in op.mix(docs).collect()}
    out = op.repeat_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: v for k, v in copies.items() if v})
    assert op.mix(awkward(spark, [])).count() == 0


def test_sources_come_within_a_hundredth(spark):
    """At sf0.01 (50 documents a source, one of which may hold most of its words) and above; at sf0.001 (10) within a twentieth."""
    for folder, most in ((SMALL, 0.05), ("/root/testdata/sf0.01", 0.01)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        rows = op.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()
        assert len(rows) == 20 and all(abs(r["taken"] - r["target"]) <= most * r["target"] for r in rows), [(r["source"], r["taken"] / r["target"]) for r in rows]
        assert max(r["copies"] for r in rows) <= op.MOST


def test_places_count_rows_of_each_source(spark):
    rows = [("s" if i % 3 else None, i * 7 % 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, size long, n long")
    got = {r["n"]: r["_before"] for r in op.running_sum(df, "source", [F.desc("size"), "n"], F.lit(1), parts=9).collect()}
    for source in ("s", None):
        assert [got[n] for _, n in sorted((-size, n) for s, size, n in rows if s == source)] == list(range(sum(s == source for s, _, _ in rows)))
