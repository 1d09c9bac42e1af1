"""Durable intermediates: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local, a temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="touchline-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a materialised table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_of(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """Names, lengths and times of the files behind some tables (a file, or a folder of files): changes if the tables do."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        for s in where.getFileSystem(conf).listStatus(where):
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def _drop_all() -> None:
    while _kept:
        spark, path = _kept.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner cleans up then
            return


atexit.register(_drop_all)


class Materialized:
    """A table written once to the shared folder: stable under lost executors, and cut off from its lineage."""

    def __init__(self, df: DataFrame, codec: str = "zstd") -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/touchline-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        _kept.append((self.spark, self.path))
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
        if (self.spark, self.path) in _kept:
            _kept.remove((self.spark, self.path))


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return Materialized(df, codec).read()
