"""Tables kept in the shared folder, so that what many queries read is made once.

A kept table is named by what it was made of: the paths, sizes and times of the files, as Spark lists them.
Where a file changes, the name does, and the table is made anew; nothing is held in the driver's memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that was set as checkpoint folder; a
    local one only where Spark itself runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.gettempdir() + "/quadscope-shared"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Move a folder; false if ``to`` is there already."""
    jvm = spark.sparkContext._jvm
    where, there = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(there) and files.rename(where, there)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a fresh folder of the shared one and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of tables from ``written`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def files_of(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, str]]:
    """(path, size, time) of the files of tables, without their content."""
    found = spark.read.format("binaryFile").load(paths).selectExpr("path", "length", "cast(modificationTime as string) as time")
    return sorted((r.path, r.length, r.time) for r in found.collect())


def kept(spark: SparkSession, name: str, made_of: object, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` made of ``made_of``: read if it is there, else written first, partitioned ``by``."""
    path = f"{shared_dir(spark)}/{name}-{hashlib.md5(repr(made_of).encode()).hexdigest()}"
    if not exists(spark, path + "/_SUCCESS"):
        part = f"{path}.{uuid.uuid4().hex}"
        writer = make().write
        (writer.partitionBy(*by) if by else writer).parquet(part)
        if not rename(spark, part, path):  # another one was quicker
            remove(spark, part)
    return spark.read.parquet(path)
