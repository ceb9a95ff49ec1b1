"""Sessions of events, and streams that run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import new_folder


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its times carry no zone and are read as UTC."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders: the table's file is picked by name
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def run_once(stream: DataFrame, name: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result as a table in the shared folder."""
    base = new_folder(stream.sparkSession, f"stream-{name or 'q'}")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", base + "/state").option("path", base + "/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(base + "/out")
