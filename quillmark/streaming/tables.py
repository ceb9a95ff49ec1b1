"""A keyed table on shared storage that batches are merged into: the newest row of each key, and when the key was first written.

Rows are in folders by a hash of the key. A version of the table is one small file that names the folder of each bucket and, for
each writer, its last batch. A batch rewrites the buckets that it touches and no others, and becomes visible by the creation of the
next version's file, which fails if another writer was faster: then the batch is merged again, into that version. A batch that its
writer has committed before changes nothing, so a stream may replay it. Readers see whole versions only.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CREATED = "created_at"


class Files:
    """A folder of the file system that Spark uses for its address."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self._keep = spark.sparkContext._gateway.new_array(rename, 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file whole, or not at all if there is one of that name."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(self._path(draft), self._path(name), self._keep)
        except Py4JJavaError as e:
            self.fs.delete(self._path(draft), False)
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class KeyedTable:
    """``schema`` has the key, the columns of ``order`` (the newest row has the greatest) and any others; reading adds ``created_at``, the first ``order[0]`` of the key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "key", order: tuple[str, ...] = ("updated_at",), buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.names = [c for c in schema.names if c != CREATED]
        self.schema = StructType([schema[c] for c in self.names]).add(CREATED, schema[order[0]].dataType)
        self.files = Files(spark, self.path)

    def head(self) -> dict:
        """The newest version: number, folder of each bucket, last batch of each writer."""
        versions = [n for n in self.files.names("versions") if not n.startswith(".")]
        if not versions:
            return {"version": 0, "buckets": {}, "writers": {}}
        return json.loads(self.files.read(f"versions/{max(versions)}"))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._rows(sorted(self.head()["buckets"].values()))

    def _newest(self, rows: DataFrame) -> DataFrame:
        own = F.struct(*self.names)
        g = rows.groupBy(self.key).agg(F.max_by(own, F.struct(*self.order)).alias("r"), F.min(CREATED).alias(CREATED))
        return g.select(*(f"r.{c}" for c in self.names), CREATED)

    def merge(self, batch: DataFrame, batch_id: int, writer: str = "stream") -> bool:
        """Whether the batch was merged now, and not before."""
        if self.head()["writers"].get(writer, -1) >= batch_id:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = self._newest(batch.select(*self.names, F.col(self.order[0]).alias(CREATED))).persist()
        try:
            touched = sorted(str(r["bucket"]) for r in rows.select(bucket).distinct().collect())  # no more than there are buckets
            while True:
                head = self.head()
                if head["writers"].get(writer, -1) >= batch_id:
                    return False
                old = [head["buckets"][b] for b in touched if b in head["buckets"]]
                folder = f"rows/{uuid.uuid4().hex}"
                if touched:
                    merged = self._newest(self._rows(old).unionByName(rows)).select("*", bucket)
                    merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
                version = head["version"] + 1
                told = {"version": version, "buckets": head["buckets"] | {b: f"{folder}/bucket={b}" for b in touched}, "writers": head["writers"] | {writer: batch_id}}
                if self.files.create(f"versions/{version:012d}", json.dumps(told)):
                    return True
                self.files.delete(folder)
        finally:
            rows.unpersist()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last ``keep``, and folders that none of these names; call it while nothing merges. Returns the number of folders."""
        versions = sorted(n for n in self.files.names("versions") if not n.startswith("."))
        kept = {f.split("/bucket=")[0] for v in versions[-keep:] for f in json.loads(self.files.read(f"versions/{v}"))["buckets"].values()}
        for v in versions[:-keep]:
            self.files.delete(f"versions/{v}")
        old = [f"rows/{n}" for n in self.files.names("rows") if f"rows/{n}" not in kept]
        for folder in old:
            self.files.delete(folder)
        return len(old)


def upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "stream", failed: str | None = None):
    """Starts a stream that merges its batches into the table until its input is used up; rows whose ``failed`` is true are never stored."""
    rows = stream.where(~F.coalesce(F.col(failed), F.lit(False))) if failed else stream
    return rows.writeStream.foreachBatch(lambda batch, i: table.merge(batch, i, writer) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
