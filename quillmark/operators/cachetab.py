"""A keyed cache as a table: latest values, expiry with two lifetimes, prefix counts, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE_TTL, NEGATIVE_TTL = 24 * 3600, 15 * 60


def latest(rows: DataFrame) -> DataFrame:
    """One row per key: the newest value (the larger id at a tie), and when the key was first written."""
    return rows.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "row_id")).alias("value"), F.max("updated_at").alias("updated_at"), F.min("updated_at").alias("created_at"), F.count(F.lit(1)).alias("writes"))


def alive(rows: DataFrame, now: Column, positive: int = POSITIVE_TTL, negative: int = NEGATIVE_TTL) -> DataFrame:
    """Rows that have not expired; rows that hold no records live shorter, and a lifetime of 0 is over at once."""
    ttl = F.when(F.col("record_count") == 0, negative).otherwise(positive)
    return rows.where((now - F.col("updated_at") < ttl) & (ttl > 0))


def prefix_counts(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("key").startswith("search:"), "search").when(F.col("key").startswith("lookup:"), "lookup").otherwise("other")
    return rows.groupBy(kind.alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"))
