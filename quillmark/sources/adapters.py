"""Views of the driver's tables as citations, claims, verdicts and cache rows (the tables hold no identifiers or years of their own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # the first eight words, without a pass over the rest of the text
    first = F.regexp_extract(F.coalesce("text", F.lit("")), "^[ \\t\\r\\n]*((?:[^ \\t\\r\\n]++[ \\t\\r\\n]++){0,7}[^ \\t\\r\\n]*+)", 1)
    return d.select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("citation_id"),
        F.trim(F.regexp_replace(first, "[ \\t\\r\\n]+", " ")).alias("title"),
        F.coalesce("text", F.lit("")).alias("abstract"),
        (1990 + F.col("doc_id") % 35).cast("int").alias("year"),
        F.concat(F.lit("https://doi.org/10."), (1000 + F.col("doc_id") % 9000).cast("string"), F.lit("/Doc."), F.col("doc_id").cast("string"), F.lit(".")).alias("doi"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("arXiv: 2001."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v2"))).otherwise("").alias("arxiv_id"),
        F.array(F.concat(F.lit("Author "), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("Author "), (F.col("doc_id") % 5).cast("string"))).alias("authors"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("Venue "), (F.col("doc_id") % 11).cast("string"))).alias("venue"),
        "source",
        "n_chars",
    )


#: The same view in SQL.
CORPUS_SQL = r"""
SELECT doc_id, 'doc:' || doc_id AS citation_id,
  array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')), ' '), 1, 8), ' ') AS title,
  coalesce(text, '') AS abstract, CAST(1990 + doc_id % 35 AS INTEGER) AS year,
  'https://doi.org/10.' || (1000 + doc_id % 9000) || '/Doc.' || doc_id || '.' AS doi,
  CASE WHEN doc_id % 3 = 0 THEN 'arXiv: 2001.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v2' ELSE '' END AS arxiv_id,
  ['Author ' || (doc_id % 7), 'Author ' || (doc_id % 5)] AS authors,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Venue ' || (doc_id % 11) END AS venue, source, n_chars
FROM documents"""


#: Of the citations with a title only, every second one lacks the first character of its title. What is left is one stretch of the title, so the
#: ratio is 2(n - 1) / (2n - 1); very long titles are left out, as the ratio does not count what is frequent in 200 characters and more.
TYPO_SQL = "doc_id % 10 = 7 AND length(title) BETWEEN 30 AND 150"


def typo() -> Column:
    return F.expr(TYPO_SQL)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations to check: each is a document cited with a DOI, an arXiv id, only a title, or something that is not there."""
    c = corpus(spark, sf_dir)
    kind = F.col("doc_id") % 5
    return c.select(
        F.col("doc_id").alias("cand_id"),
        F.when(kind == 0, F.concat(F.lit("DOI: "), F.upper(F.regexp_replace("doi", "^https://doi.org/", "")))).when(kind == 3, F.concat(F.lit("10.9999/none."), F.col("doc_id").cast("string"))).otherwise("").alias("doi"),
        F.when(kind == 1, F.regexp_replace("arxiv_id", "^arXiv: ", "https://arxiv.org/abs/")).otherwise("").alias("arxiv_id"),
        F.when(kind == 4, F.concat(F.lit("unknown work "), F.col("doc_id").cast("string"))).when(typo(), F.concat(F.lit('"'), F.expr("substring(title, 2)"), F.lit('"!'))).otherwise(F.concat(F.lit('"'), "title", F.lit('"!'))).alias("title"),
        (F.col("year") + F.when(F.col("doc_id") % 7 == 0, 3).otherwise(F.col("doc_id") % 2)).cast("int").alias("year"),
        F.slice("authors", 1, 1).alias("authors"),
        F.when(F.col("doc_id") % 6 == 0, "Elsewhere").otherwise(F.col("venue")).alias("venue"),
    )


CANDIDATES_SQL = f"""
SELECT doc_id AS cand_id,
  CASE doc_id % 5 WHEN 0 THEN 'DOI: ' || upper(regexp_replace(doi, '^https://doi.org/', '')) WHEN 3 THEN '10.9999/none.' || doc_id ELSE '' END AS doi,
  CASE WHEN doc_id % 5 = 1 THEN regexp_replace(arxiv_id, '^arXiv: ', 'https://arxiv.org/abs/') ELSE '' END AS arxiv_id,
  CASE WHEN doc_id % 5 = 4 THEN 'unknown work ' || doc_id WHEN {TYPO_SQL} THEN '"' || substr(title, 2) || '"!' ELSE '"' || title || '"!' END AS title,
  CAST(year + CASE WHEN doc_id % 7 = 0 THEN 3 ELSE doc_id % 2 END AS INTEGER) AS year,
  list_slice(authors, 1, 1) AS authors,
  CASE WHEN doc_id % 6 = 0 THEN 'Elsewhere' ELSE venue END AS venue
FROM ({CORPUS_SQL})"""


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The corpus as three sources return it: each has its own share of the works and leaves fields of its own blank."""
    c = corpus(spark, sf_dir)
    k, blank, few = F.col("doc_id"), F.lit(""), F.array().cast("array<string>")
    rows = lambda name, where, score, **own: spread(c.where(where)).select("doc_id", *(own.get(f, F.col(f) if f != "url" else blank).alias(f) for f in ("title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "url")), F.lit(name).alias("source"), score.cast("double").alias("source_score"))
    return {
        "openalex": rows("openalex", k % 3 != 0, k % 97, arxiv_id=blank),
        "crossref": rows("crossref", k % 2 == 0, k % 13, abstract=blank, arxiv_id=blank, doi=F.upper("doi"), year=F.when(k % 5 != 0, F.col("year")), authors=F.when(k % 7 == 0, few).otherwise(F.col("authors")), url=F.concat(F.lit("https://example.org/"), k.cast("string"))),
        "arxiv": rows("arxiv", k % 5 < 3, F.lit(0), doi=F.when(k % 10 == 0, F.col("doi")).otherwise(blank), venue=blank),
    }


SOURCES_SQL = f"""
SELECT 0 AS src, doc_id, title, authors, year, venue, abstract, doi, '' AS arxiv_id, '' AS url, 'openalex' AS source, CAST(doc_id % 97 AS DOUBLE) AS source_score FROM ({CORPUS_SQL}) WHERE doc_id % 3 <> 0
UNION ALL SELECT 1, doc_id, title, CASE WHEN doc_id % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE authors END, CASE WHEN doc_id % 5 <> 0 THEN year END, venue, '', upper(doi), '', 'https://example.org/' || doc_id, 'crossref', CAST(doc_id % 13 AS DOUBLE) FROM ({CORPUS_SQL}) WHERE doc_id % 2 = 0
UNION ALL SELECT 2, doc_id, title, authors, year, '', abstract, CASE WHEN doc_id % 10 = 0 THEN doi ELSE '' END, arxiv_id, '', 'arxiv', 0.0 FROM ({CORPUS_SQL}) WHERE doc_id % 5 < 3"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audited citation per document: verdict, score, failed and checked sources."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("idx"),
        F.element_at(F.array(*map(F.lit, VERDICTS)), (k % 4 + 1).cast("int")).alias("verdict"),
        ((k % 101) / 100.0).alias("score"),
        F.when(k % 10 == 0, F.array(F.lit("crossref"))).when(k % 17 == 0, F.array(F.lit("openalex"), F.lit("crossref"))).otherwise(F.array().cast("array<string>")).alias("sources_failed"),
        F.array(F.lit("openalex"), F.lit("crossref")).alias("sources_checked"),
        F.when(k % 3 == 0, F.array(F.lit("openalex"))).otherwise(F.array().cast("array<string>")).alias("sources_responded"),
        "source",
    )


VERDICTS = ("verified", "metadata_mismatch", "not_found", "ambiguous")
VERDICTS_SQL = """
SELECT doc_id AS idx, ['verified', 'metadata_mismatch', 'not_found', 'ambiguous'][doc_id % 4 + 1] AS verdict,
  CAST(doc_id % 101 AS DOUBLE) / 100.0 AS score,
  CASE WHEN doc_id % 10 = 0 THEN ['crossref'] WHEN doc_id % 17 = 0 THEN ['openalex', 'crossref'] ELSE CAST([] AS VARCHAR[]) END AS sources_failed,
  ['openalex', 'crossref'] AS sources_checked,
  CASE WHEN doc_id % 3 = 0 THEN ['openalex'] ELSE CAST([] AS VARCHAR[]) END AS sources_responded, source
FROM documents"""

SUPPORT = ("supported", "weakly_supported", "insufficient_evidence", "contradicted")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases: gold and predicted support labels with facets."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    label = lambda e: F.element_at(F.array(*map(F.lit, SUPPORT)), e)
    return x.select(
        F.col("doc_id").alias("case_id"),
        label((F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0)) + 1).cast("int")).alias("gold"),
        label(((F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0)) + F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0)) % 4 + 1).cast("int")).alias("pred"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"),
        F.when(F.col("n_chars") > 2000, "full_text").when(F.col("n_chars") > 500, "abstract").otherwise("title").alias("evidence_scope"),
        F.when(F.col("doc_id") % 4 == 0, "hard_negative").when(F.col("doc_id") % 4 == 1, "direct").when(F.col("doc_id") % 4 == 2, "weak").otherwise("contradiction").alias("case_type"),
    )


JUDGED_SQL = """
SELECT doc_id AS case_id,
  ['supported', 'weakly_supported', 'insufficient_evidence', 'contradicted'][coalesce(quality, 0) * 2 + coalesce(toxic, 0) + 1] AS gold,
  ['supported', 'weakly_supported', 'insufficient_evidence', 'contradicted'][(coalesce(quality, 0) * 2 + coalesce(toxic, 0) + CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1] AS pred,
  coalesce(lang, 'unknown') AS lang, ['train', 'dev', 'test'][doc_id % 3 + 1] AS split,
  CASE WHEN n_chars > 2000 THEN 'full_text' WHEN n_chars > 500 THEN 'abstract' ELSE 'title' END AS evidence_scope,
  CASE doc_id % 4 WHEN 0 THEN 'hard_negative' WHEN 1 THEN 'direct' WHEN 2 THEN 'weak' ELSE 'contradiction' END AS case_type
FROM labels JOIN documents USING (doc_id)"""


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than the session has cores is dealt over all of them, so that work on whole texts is not one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
