"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors are the driver itself.
ONE_MACHINE = re.compile(r"local(\[[^\]]*\])?")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not ONE_MACHINE.fullmatch(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="cuegrid-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in reliable storage; keeps the hash partitioning of df."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/cuegrid-tables/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as parquet in the shared folder, with the writer's options, and read it back.

    Preferred over cut() when many readers follow: column pruning and filter
    pushdown reach the files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def source_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and modification time of a source table, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _on_files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, on any Hadoop file system; nothing for a missing folder."""
    p, fs = _on_files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, on any Hadoop file system."""
    p, fs = _on_files(spark, path)
    fs.delete(p, True)
