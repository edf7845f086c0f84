"""Where jobs keep tables between steps: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where a local session (tests) names none, a fresh temporary folder is set as the checkpoint folder; on a cluster that raises, for
    every executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-terrajobs-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/terrajobs-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and not a recomputation, and pins results that
    a second evaluation might deal differently (partition ids, range bounds). The files stay until ``drop`` or ``clear``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrajobs_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more; other tables stay."""
    if (path := getattr(df, "_terrajobs_path", None)) is not None:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application's jobs have left in the shared folder.

    For when their results are written: a result that is still to be read, and archives or indexes that were given no path, go too.
    """
    _delete(spark, _own_dir(spark))


def swap_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of another in one step: who reads ``path`` sees the old text or the new one whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    qualified = where.getFileSystem(conf).makeQualified(where)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(where.getFileSystem(conf).makeQualified(beside), qualified, options)


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    file = store.open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file; one that is not there does no harm."""
    _delete(spark, path)
