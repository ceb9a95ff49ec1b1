"""Readers of corpora, citations, source payloads, manuscripts and evidence; everything becomes one record schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.ident import normalize_arxiv, normalize_doi, stable_id
from quillmark.functions.text import blank, strip_tags

RECORD = "citation_id string, title string, authors array<string>, year int, venue string, abstract string, doi string, arxiv_id string, url string, source string"
CITATION = "raw_text string, title string, authors array<string>, year string, venue string, abstract string, doi string, arxiv_id string, claim string, lang string, _corrupt_record string"
#: Hosts behind a login, which are never fetched.
GATED = ("ieeexplore.ieee.org", "dl.acm.org", "sciencedirect.com", "link.springer.com", "onlinelibrary.wiley.com")


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    """The record schema with empty strings for absent text."""
    out = []
    for field in RECORD.split(", "):
        name, kind = field.split(" ", 1)
        c = columns.get(name)
        if c is None:
            c = F.lit(None)
        c = c.cast(kind)
        out.append((F.coalesce(c, F.lit("")) if kind == "string" else F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).alias(name))
    return df.select(*out)


def citations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list or JSON lines (by suffix) of citations; rows without any of raw_text, title, doi and arxiv_id are marked in ``error``."""
    rows = spark.read.schema(CITATION).option("multiLine", not path.endswith(".jsonl")).option("mode", "PERMISSIVE").json(path)
    given = F.concat(*(blank(c) for c in ("raw_text", "title", "doi", "arxiv_id")))
    error = F.when(F.col("_corrupt_record").isNotNull(), "not an object").when(F.length(F.trim(given)) == 0, "one of raw_text, title, doi, arxiv_id is required")
    return rows.withColumn("year", F.col("year").try_cast("int")).withColumn("error", error)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines, a JSON list, or an object with a list ``records``."""
    raw = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    if "records" in raw.columns:
        raw = raw.select(F.explode("records").alias("r")).select("r.*")
    have = {c: F.col(c) for c in raw.columns}
    fallback = stable_id("fixture", have.get("title", F.lit("")))
    ids = F.coalesce(have["citation_id"], fallback) if "citation_id" in have else fallback
    return _record(raw, **(have | {"citation_id": ids, "source": F.coalesce(have.get("source", F.lit(None).cast("string")), F.lit("fixture"))}))


def openalex(works: DataFrame) -> DataFrame:
    """Works with an inverted index of the abstract: positions are sorted, the last token of a position wins."""
    pairs = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    ordered = F.map_from_arrays(F.array_distinct(F.transform(pairs, lambda x: x["p"])), F.transform(F.array_distinct(F.transform(pairs, lambda x: x["p"])), lambda p: F.element_at(F.filter(pairs, lambda y: y["p"] == p), -1)["t"]))
    abstract = F.array_join(F.transform(F.array_sort(F.map_keys(ordered)), lambda p: F.element_at(ordered, p)), " ")
    return _record(
        works.withColumn("__abstract", abstract),
        citation_id=F.concat(F.lit("openalex:"), F.substring_index("id", "/", -1)),
        title=F.col("display_name"), authors=F.transform("authorships", lambda a: a["author"]["display_name"]), year=F.col("publication_year"),
        venue=F.col("primary_location.source.display_name"), abstract=F.col("__abstract"), doi=normalize_doi("doi"), url=F.col("id"), source=F.lit("openalex"),
    )


def crossref(works: DataFrame) -> DataFrame:
    year = F.try_element_at(F.try_element_at(F.col("issued.`date-parts`"), F.lit(1)), F.lit(1))
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    return _record(
        works, citation_id=F.concat(F.lit("crossref:"), normalize_doi("DOI")), title=strip_tags(F.try_element_at("title", F.lit(1))), authors=F.transform("author", name), year=year,
        venue=F.try_element_at("container-title", F.lit(1)), abstract=strip_tags("abstract"), doi=normalize_doi("DOI"), url=F.col("URL"), source=F.lit("crossref"),
    )


def semantic_scholar(papers: DataFrame) -> DataFrame:
    return _record(
        papers, citation_id=F.concat(F.lit("s2:"), F.col("paperId")), title=F.col("title"), authors=F.transform("authors", lambda a: a["name"]), year=F.col("year").cast("string").try_cast("int"), venue=F.col("venue"),
        abstract=F.col("abstract"), doi=normalize_doi(F.col("externalIds.DOI")), arxiv_id=normalize_arxiv(F.col("externalIds.ArXiv")), url=F.col("url"), source=F.lit("semantic_scholar"),
    )


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files, by the built-in XML reader; entries without id and title are dropped."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    clean = lambda c: F.trim(F.regexp_replace(blank(c), "\\s+", " "))
    rows = rows.where((F.length(normalize_arxiv("id")) > 0) | (F.length(clean("title")) > 0))
    return _record(rows, citation_id=F.concat(F.lit("arxiv:"), normalize_arxiv("id")), title=clean("title"), authors=F.transform("author", lambda a: a["name"]), year=F.substring("published", 1, 4).try_cast("int"), abstract=clean("summary"), arxiv_id=normalize_arxiv("id"), url=F.col("id"), source=F.lit("arxiv"))


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files, one text per file; files that are none give an empty text."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from html import unescape

        for frame in frames:
            texts = []
            for content in frame["content"]:
                try:
                    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
                except (zipfile.BadZipFile, KeyError):
                    xml = ""
                lines = ["".join(unescape(t) for t in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)]
                texts.append("\n".join(x for x in lines if x.strip()))
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def allowed_url(url: Column) -> Column:
    """http or https, no local or private host, none of the gated ones."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    private = host.rlike("^(?:localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|0\\.|\\[)")
    gated = F.lit(False)
    for name in GATED:
        gated = gated | (host == name) | host.endswith("." + name)
    return F.coalesce(F.lower(url).rlike("^https?://") & (F.length(host) > 0) & ~private & ~gated, F.lit(False))
