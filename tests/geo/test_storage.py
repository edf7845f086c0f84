import os

import pytest

from terrajobs.functions import graph, storage


def test_tables_are_written_dropped_and_cleared(spark):
    df = storage.materialize(spark.range(5).toDF("n"), "numbers")
    path = df._terrajobs_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    storage.drop(df.where("n > 1"))  # not the table itself
    assert os.path.isdir(path)
    storage.drop(df)
    assert not os.path.exists(path)
    kept = storage.fresh_path(spark, "kept").removeprefix("file:")
    storage.materialize(spark.range(3).toDF("n"), "more")
    assert os.path.isdir(os.path.dirname(kept))
    storage.clear(spark)
    assert not os.path.exists(os.path.dirname(kept))


def test_components_leave_one_table(spark):
    storage.clear(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    found = graph.connected_components(edges)
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 41
    assert len(os.listdir(os.path.dirname(storage.fresh_path(spark, "x").removeprefix("file:")))) == 1
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_a_cluster_without_shared_folder_raises():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
