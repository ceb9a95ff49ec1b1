"""Chunks of evidence of a record: merged in the order in which they were gathered, and attached to resolved records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import blank, collapse, normalize_text

#: What a chunk says of itself beside its text, field and address; a blank one is filled from a later chunk of the same text.
FACTS = ("source_name", "evidence_scope", "retrieved_at", "retrieval_source")
NAMES = ("text", "source_field", "source_url", *FACTS)


def _two(a: Column, b: Column) -> Column:
    """A chunk and a later one of the same text: the later one takes its place if only that has an address, else blank facts are filled from it."""
    later = (F.length(a["source_url"]) == 0) & (F.length(b["source_url"]) > 0)
    kept = [F.when(later, b[f]).otherwise(a[f]).alias(f) for f in ("text", "source_field", "source_url")]
    facts = [F.when(later | (F.length(a[f]) == 0), b[f]).otherwise(a[f]).alias(f) for f in FACTS]
    return F.struct(*kept, *facts)


def merge(chunks: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """(owner, position, and the columns of a chunk): chunks of one text, in any case and spacing, are one, where the first of them stood.

    ``chunks``: owner, the columns of ``order`` (a total order within an owner) and any of NAMES; chunks without text go. Chunks are grouped by
    owner and text, so an owner with many chunks is spread over tasks until they are numbered.
    """
    has = set(chunks.columns)
    said = {f: collapse(f) if f == "text" else F.coalesce(F.col(f).cast("string"), F.lit("metadata_span" if f == "source_field" else "")) if f in has else F.lit("metadata_span" if f == "source_field" else "") for f in NAMES}
    rows = chunks.select(owner, F.struct(*order).alias("at"), F.struct(*(x.alias(f) for f, x in said.items())).alias("chunk")).where(F.length("chunk.text") > 0)
    g = rows.groupBy(owner, F.lower("chunk.text").alias("key")).agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("x"))
    one = F.aggregate(F.slice("x", F.lit(2), F.size("x")), F.col("x")[0]["chunk"], lambda acc, y: _two(acc, y["chunk"]))
    merged = g.select(owner, F.col("x")[0]["at"].alias("at"), one.alias("chunk"))
    position = F.row_number().over(Window.partitionBy(owner).orderBy("at"))
    return merged.withColumn("position", position).select(owner, "position", *(f"chunk.{f}" for f in NAMES))


def attach(pairs: DataFrame) -> DataFrame:
    """Adds abstract and own: ``pairs`` has abstract (of the record) and given (of the reference). A record without an abstract takes
    the given one; one that says something else is kept as a chunk of its own."""
    theirs, given = F.trim(blank("abstract")), F.trim(blank("given"))
    other = (F.length(given) > 0) & (F.length(theirs) > 0) & (normalize_text("given") != normalize_text("abstract"))
    chunk = F.struct(given.alias("text"), F.lit("user_provided_abstract").alias("source_field"), F.lit("").alias("source_url"), F.lit("abstract").alias("evidence_scope"))
    return pairs.withColumns({"own": F.when(other, chunk), "abstract": F.when(F.length(theirs) == 0, given).otherwise(F.col("abstract"))})
