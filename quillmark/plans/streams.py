"""Queries of streams whose result equals a batch rule, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import cachetab
from quillmark.plans.catalogue import _CACHE, _CASCADE, _FIELDS, _cache, _query
from quillmark.session import new_folder
from quillmark.sources import adapters as A
from quillmark.streaming import audits, expiry, tables

_FILES = 3


def _as_stream(rows, name: str, order: str):
    """The rows as a stream: files by ranges of a column, oldest first, a file for each trigger."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    rows.repartitionByRange(_FILES, order).sortWithinPartitions(order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@_query(
    "cache_upsert_stream",
    f"""SELECT key, arg_max(value, (updated_at, row_id)) AS value, arg_max(row_id, (updated_at, row_id)) AS row_id, max(updated_at) AS updated_at, min(updated_at) AS created_at
    FROM ({_CACHE}) WHERE row_id % 9 <> 0 GROUP BY key""",
)
def cache_upsert_stream(spark, sf):
    """Batches of a stream merged into a keyed table; every ninth request failed and is not stored."""
    rows = _cache(spark, sf).withColumn("failed", F.col("row_id") % 9 == 0)
    stream = _as_stream(rows, "requests", "row_id")
    folder = new_folder(spark, "cache-table")
    table = tables.KeyedTable(spark, folder + "/table", rows.select("key", "row_id", "value", "updated_at").schema, order=("updated_at", "row_id"), buckets=8)
    tables.upserts(stream, table, folder + "/state", failed="failed").awaitTermination()
    return table.read().select("key", "value", "row_id", "updated_at", "created_at")


@_query(
    "cache_ttl_stream",
    f"""WITH c AS (SELECT key, row_id, updated_at, record_count, max(updated_at) OVER () AS now FROM ({_CACHE})),
    l AS (SELECT key, arg_max(row_id, (epoch_ms(updated_at), row_id)) AS row_id, max(updated_at) AS updated_at, arg_max(record_count, (epoch_ms(updated_at), row_id)) AS record_count, any_value(now) AS now FROM c WHERE row_id % 9 <> 0 GROUP BY key)
    SELECT key, row_id FROM l WHERE epoch_ms(now) - epoch_ms(updated_at) < CASE WHEN record_count = 0 THEN {cachetab.NEGATIVE_TTL} ELSE {cachetab.POSITIVE_TTL} END * 1000""",
)
def cache_ttl_stream(spark, sf):
    """The entries that the state of the stream still holds when its watermark has reached the last event."""
    rows = _cache(spark, sf).select("key", "row_id", F.col("value").cast("string").alias("value"), F.col("record_count").cast("long").alias("record_count"), (F.col("row_id") % 9 == 0).alias("failed"), F.col("updated_at").cast("timestamp").alias("at"))
    before = {k: spark.conf.get(k, None) for k in expiry.STATE_STORE}
    for k, v in expiry.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        folder = new_folder(spark, "cache-states")
        q = expiry.changes(_as_stream(rows, "entries", "at")).writeStream.format("parquet").option("checkpointLocation", folder + "/state").option("path", folder + "/out").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(expiry.CHANGES).parquet(folder + "/out")
    last = out.groupBy("key").agg(F.max_by(F.struct("change", "row_id"), F.struct("updated_at", "row_id", F.col("change") == "expired")).alias("x"))
    return last.where("x.change = 'put'").select("key", "x.row_id")


@_query(
    "audit_stream",
    f"""WITH {_CASCADE}, {_FIELDS}, m AS (SELECT cand_id, count(*) FILTER (NOT matches) AS mismatches FROM f GROUP BY cand_id)
    SELECT r.cand_id, r.doc_id, method, coalesce(mismatches, 0) AS mismatches,
    CASE WHEN method = 'none' THEN 'not_found' WHEN mismatches > 0 THEN 'metadata_mismatch' ELSE 'verified' END AS verdict FROM r LEFT JOIN m USING (cand_id)""",
)
def audit_stream(spark, sf):
    """References that arrive in several files, some of them twice, audited as they come."""
    rows = A.candidates(spark, sf)
    again = rows.where("cand_id % 10 = 0")
    folder = new_folder(spark, "audit-stream")
    audits.audits(_as_stream(rows.unionByName(again), "references", "cand_id"), A.corpus(spark, sf), folder).awaitTermination()
    return audits.results(rows, folder)
