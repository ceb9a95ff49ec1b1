"""The corpus pipeline: language ID, near-duplicates, personal data, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last return the columns of their input. Language ID drops what it rejects, near-duplicate
detection keeps one document of each group, personal data is replaced by the name of its kind, mixing puts the
documents in the order of the mixture (files and rows of the written table follow it), and packing cuts that stream of
tokens into sequences. Columns that a stage does not use may have any name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm import langid, minhash, mixing, packing, pii
from quillmark.llm.scratch import Scratch

#: Columns that stages use by name; all others are numbered on their way through a stage.
USED = ("doc_id", "text", "lang", "source", "n_chars")

#: Not expressible in SQL: trained models, hashing and a tokenizer. tests/llm compares the stages with brute force.
ORACLE_SQL = None


#: Up to so many files (about 100 bytes each) number the rows of a table; the rows of more are written once with numbers.
MAX_FILES = 200_000


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").alias(c if c in USED else f"extra{i}") for i, c in enumerate(docs.columns)]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(*_columns(docs))


def _with_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Adds ``row``, the number of the row's file and its place there: the same whenever the files are read, so they need no copy."""
    work = Scratch(spark, "rows")
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").cast("long").alias("place"), *_columns(docs))
        files = work.write(docs.select(F.col("_metadata.file_path").alias("path")).distinct(), "files")
    except AnalysisException:  # not read from files
        files = None
    if files is None or files.count() > MAX_FILES:
        return work.write(docs.select(F.monotonically_increasing_id().alias("row"), *_columns(docs)), "docs")
    files = files.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file"))
    return rows.join(F.broadcast(files), "path").withColumn("row", F.shiftleft("file", 40) + F.col("place")).drop("path", "file", "place")


def _named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return kept.select(*(F.col(c if c in USED else f"extra{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are rejected, or without letters."""
    plain = _numbered(docs)
    model = langid.learn(spark, plain, F.lit(True))
    keys = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    return _named(langid.keep(spark, plain, model, keys).where(~F.col("__rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links (80 % of the five-word shingles) stays, the first by a row number; doc_ids may repeat or be null."""
    whole = _with_rows(spark, docs)
    found = minhash.near_duplicates(spark, whole.select(F.col("row").alias("doc_id"), "text"))
    return _named(whole.join(found.where("kept").select(F.col("doc_id").alias("row")), "row", "left_semi"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes ``<KIND>``."""
    return pii.redact(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return _named(mixing.mix(spark, _with_rows(spark, docs), row="row"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work.table(stage(spark, docs, sf_dir), name)
        if before:  # nothing reads the table of the stage before from here on
            work.delete(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
