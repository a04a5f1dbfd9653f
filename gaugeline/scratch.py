"""Lineage cuts in the folder that driver and executors share.

A result that several later steps read is written there once as Parquet and read
back, so a lost executor costs a re-read and never a recomputation of the chain.
The folder is the one the session names in spark.checkpoint.dir. Only a session in
one JVM (tests, a laptop) gets a temporary folder where that is unset; on a cluster
a missing setting is an error, since executors would not share such a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession



def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, made on a local disk only if it is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gaugeline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A place in the shared folder where nothing is yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what was written there removed when the session ends."""
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)


def write(df: DataFrame, tag: str, kind: str = "parquet", **options) -> str:
    """Write df to the shared folder and return the place; the files go when the session ends."""
    path = new_path(df.sparkSession, tag)
    df.write.format(kind).options(**options).save(path)
    until_exit(df.sparkSession, path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back; the files go at discard() or when the session ends."""
    path = write(df, tag)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove what materialise wrote for these, once nothing reads it any more; other frames are left alone."""
    for df in written:
        path = getattr(df, "_scratch_path", None)
        if path:
            where, files = _file_system(df.sparkSession, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)
