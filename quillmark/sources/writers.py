"""Sinks: reports and packets as JSON lines with sorted keys, corpora as record files, frozen indexes, artifacts of a run."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> Column:
    """A row as one JSON object whose keys are sorted; null fields are written."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def json_lines(df: DataFrame, path: str) -> None:
    df.select(as_json(df).alias("value")).write.mode("overwrite").text(path)


def corpus(df: DataFrame, path: str, required: tuple[str, ...] = ("citation_id", "title")) -> None:
    """Records as JSON lines; a row that lacks a required field is an error that names the field, and ends the write."""
    checks = [F.when(F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == 0, F.raise_error(F.lit(f"a record lacks {c}"))) for c in required]
    held = F.coalesce(*checks, as_json(df))
    df.select(held.cast("string").alias("value")).write.mode("overwrite").text(path)


def frozen_index(df: DataFrame, path: str, key: str = "citation_id") -> None:
    """Parquet in the order of the key: ranges of keys in files, sorted within, so a reader can skip files by their statistics."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "run"


def flattened(value: object, prefix: str = "") -> dict[str, object]:
    """Numbers, texts and booleans of a nested result under dotted names."""
    if isinstance(value, dict):
        return {k: v for name, inner in value.items() for k, v in flattened(inner, f"{prefix}.{name}" if prefix else str(name)).items()}
    return {prefix: value} if isinstance(value, int | float | str | bool) or value is None else {}


def artifacts(spark: SparkSession, name: str, result: dict, config: dict, folder: str, run_id: str) -> str:
    """Result, configuration and manifest of a run, a JSON text each, under ``folder/name/run_id``; the path."""
    base = f"{folder.rstrip('/')}/{slug(name)}/{slug(run_id)}"
    about = {"name": name, "run_id": run_id, "files": ["config", "result"], "summary": flattened(result)}
    for part, value in (("result", result), ("config", config), ("manifest", about)):
        spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{part}")
    return base


def markdown(lines: DataFrame, order: str, path: str, title: str) -> None:
    """A report of one line per row, in order, under a title."""
    head = lines.sparkSession.createDataFrame([(f"# {title}\n",)], "value string")
    body = lines.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.col("line").alias("value"))
    head.unionByName(body).write.mode("overwrite").text(path)
