"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that is unset (tests on one machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


class Scratch:
    """Tables that live until they are freed or the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        fs, target = _fs(spark, self.root)
        fs.mkdirs(target)
        fs.deleteOnExit(target)  # should the session be gone before this process ends
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        return out

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_tessella_path", None)
            if path:
                delete(self.spark, path)

    def _close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may be gone by then
            pass
