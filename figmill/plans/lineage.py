"""Cutting lineage and staging tables in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where none is set and all runs on one machine.

    A cluster must name a folder every executor can reach: without one it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = named or "file://" + tempfile.mkdtemp(prefix="figmill-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    return named or current.get()


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table written in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/figmill-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; with ``by``, in one folder per value of that column.

    Used in loops rather than ``checkpoint``, whose result carries the old plan's
    constraints along: over many rounds these outgrow the data.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._figmill_path = path
    return out


def spread(df: DataFrame, key: str, waves: int = 4) -> DataFrame:
    """Rows over all cores by ``key`` where the input comes in few pieces; large inputs are left as they are.

    For steps that work hard on each row: a small table is often one file, which
    one task would read.  An input of more than ``waves`` pieces per core is not
    shuffled.
    """
    n = waves * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def release(*tables: DataFrame | None) -> None:
    """Drop the files of tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_figmill_path", None)
        if path:
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table, if it is there."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Atomic rename of a folder; False where the target is already there.

    ``FileContext`` renames without overwriting: of two that try at once, one gets
    the exception.  (``FileSystem.rename`` would move the folder into the other's.)
    """
    from py4j.protocol import Py4JJavaError

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or exists(spark, target):
            return False
        raise
    return True


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; empty where it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
