"""Intermediate tables in the folder that the cluster shares.

A written table cuts lineage and survives a lost executor: the folder in ``spark.checkpoint.dir`` is
visible to the driver and all executors. Only where that setting is absent and the master is local
(tests, a laptop) a temporary folder of this machine is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        base = _OWN.setdefault(key, "file://" + tempfile.mkdtemp(prefix="quillmark-"))
    return base.rstrip("/")


class Scratch:
    """Writes tables under one folder; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def table(self, df: DataFrame, name: str) -> str:
        """Writes a table and returns its path."""
        path = self.path(name)
        df.write.parquet(path)
        return path

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = self._paths.pop(id(df), None)
            if path:
                self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
