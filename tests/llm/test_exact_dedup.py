import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrajobs.llm import exact_dedup as op

from .common import AWKWARD, SMALL, awkward


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out[(r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    return out


def answers(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in df.collect())


def test_against_brute_force(spark):
    assert answers(op.add_batch(spark, op.open_index(spark), op.digests(awkward(spark)))) == brute(AWKWARD)


def test_empty_table(spark):
    index = op.open_index(spark)
    assert op.add_batch(spark, index, op.digests(awkward(spark, []))).count() == 0
    assert op.deduplicate(awkward(spark, []), index).count() == 0


def test_index_persists_over_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    first = op.open_index(spark, "first_name", path, buckets=4)
    op.add_batch(spark, first, op.digests(awkward(spark))).count()
    again = op.open_index(spark, "second_name", path, buckets=4)
    batch = awkward(spark, [(100, AWKWARD[0][1], *AWKWARD[0][2:]), (101, "new text", *AWKWARD[0][2:])])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in op.add_batch(spark, again, op.digests(batch)).collect()}
    assert got == {100: (2, 3, False), 101: (101, 1, True)}
    assert spark.table(again).where("keep_id = 101").count() == 1


def test_rows_that_stay(spark):
    docs = awkward(spark)
    stay = op.deduplicate(docs, op.open_index(spark))
    assert stay.columns == docs.columns
    ids = Counter(r["doc_id"] for r in stay.collect())
    assert ids == Counter([2, 4, 5, 6, 7, 8, 9, 10, 10, 11, 11, None, 12])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("buckets", [4, 32])
def test_anti_join_reads_the_index_without_shuffle_or_sort(spark, no_broadcast, buckets):
    """With as many buckets as shuffle partitions and with more; after a second batch a bucket has two files and is sorted, until compacted."""
    index = op.open_index(spark, buckets=buckets)
    op.append_batch(spark, index, op.digests(awkward(spark)))
    groups = op.materialize(op.digests(awkward(spark)).groupBy("digest").count(), "groups")

    def index_side(name):
        with op._sorted_buckets(spark):
            plan = plan_of(op.unseen(groups, name, 9))
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = lines[at].index("FileScan")
        join = max(i for i, line in enumerate(lines[:at]) if "SortMergeJoin" in line)
        # The operators above the scan are those on the way to the join that are less deep than it.
        above, low = [], depth
        for line in reversed(lines[join + 1 : at]):
            here = len(line) - len(line.lstrip(" :+-"))
            if here < low:
                above.append(line)
                low = here
        return above

    assert not any("Exchange" in line or "Sort" in line for line in index_side(index))
    op.append_batch(spark, index, op.digests(awkward(spark, AWKWARD[:3])))
    assert not any("Exchange" in line for line in index_side(index)) and any("Sort" in line for line in index_side(index))
    again = op.compact(spark, index)
    assert not any("Exchange" in line or "Sort" in line for line in index_side(again))
    pairs = lambda name: sorted(map(tuple, op.totals(spark, name, 9).collect()), key=str)
    assert pairs(again) == pairs(index)


def test_three_batches_and_one_again(spark):
    """Sizes of all batches add up; a batch that is tried again changes nothing, also when half of it was written."""
    index = op.open_index(spark)
    text = AWKWARD[0][1]
    batches = [awkward(spark, [(i, text, *AWKWARD[0][2:]), (10 + i, f"own text {i}", *AWKWARD[0][2:])]) for i in (5, 6, 7)]
    got = [op.add_batch(spark, index, op.digests(b), n).collect() for n, b in enumerate(batches)]
    sizes = [{r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} for rows in got]
    assert sizes == [{5: (5, 1, True), 15: (15, 1, True)}, {6: (5, 2, False), 16: (16, 1, True)}, {7: (5, 3, False), 17: (17, 1, True)}]
    before = spark.table(index).count()
    again = op.add_batch(spark, index, op.digests(batches[1]), 1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got[1])) and spark.table(index).count() == before
    assert [r["doc_id"] for r in op.deduplicate(batches[1], index, batch=1).collect()] == [16]

    half = op.open_index(spark)
    hashed = op.digests(awkward(spark))
    groups = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    some = groups.where(F.col("digest") < "8").withColumn("batch", F.lit(0).cast("long"))
    some.write.insertInto(half)
    assert 0 < spark.table(half).count() < groups.count()
    assert answers(op.add_batch(spark, half, hashed, 0)) == brute(AWKWARD) and spark.table(half).count() == groups.count()


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = op.op10_exact_dedup(spark, SMALL).withColumnRenamed("text_sha256", "digest")
    assert answers(got) == brute(rows)
