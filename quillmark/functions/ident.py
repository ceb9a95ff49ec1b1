"""Identifiers of scholarly records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import Text, blank, collapse, normalize_text

#: What identifiers look like.
DOI = "(?i)10\\.[0-9]{4,9}/[-._;()/:a-z0-9]+"
ARXIV = "(?:[0-9]{4}\\.[0-9]{4,5}|[a-z][a-z-]*(?:\\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?"
YEAR = "\\b(?:19|20)[0-9]{2}\\b"
GBT_TYPE = "\\[(EB|DB|CP|CM|DS|[JMCDRSPNAZG])(?:/(?:OL|CD|DK|MT))?\\]"


def normalize_doi(c: Text) -> Column:
    """Prefixes (``doi:``, resolver addresses) go in any order and number, then final ``.,;``; lower case."""
    bare = F.regexp_replace(F.trim(blank(c)), "(?i)^(?:\\s*(?:doi\\s*:?\\s*|(?:https?://)?(?:dx\\.)?doi\\.org/))+", "")
    return F.lower(F.regexp_replace(F.trim(bare), "[.,;]+$", ""))


def normalize_arxiv(c: Text) -> Column:
    x = F.regexp_replace(F.trim(blank(c)), "^[<>()\\[\\]{}]+|[<>()\\[\\]{}]+$", "")
    x = F.regexp_replace(x, "(?i)^(?:\\s*(?:arxiv\\s*:\\s*|(?:https?://)?arxiv\\.org/(?:abs|pdf|html)/))+", "")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, "[?#].*$", "")), "^/+|/+$", "")
    x = F.regexp_replace(F.regexp_replace(x, "[.,;]+$", ""), "(?i)\\.pdf$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), "^/+|/+$", ""), "[.,;]+$", ""))


def base_arxiv(c: Text) -> Column:
    return F.regexp_replace(normalize_arxiv(c), "v[0-9]+$", "")


def extract_doi(c: Text) -> Column:
    return normalize_doi(F.regexp_extract(blank(c), DOI, 0))


def extract_arxiv(c: Text) -> Column:
    """Labelled ids before those in addresses, those before bare ones."""
    found = [F.nullif(F.regexp_extract(blank(c), f"(?i){lead}({ARXIV}){tail}", 1), F.lit("")) for lead, tail in (("arxiv:\\s*", ""), ("https?://arxiv\\.org/(?:abs|pdf|html)/", ""), ("\\barxiv\\.org/(?:abs|pdf|html)/", ""), ("\\b", "\\b"))]
    return normalize_arxiv(F.coalesce(*found, F.lit("")))


def extract_year(c: Text) -> Column:
    return F.nullif(F.regexp_extract(blank(c), YEAR, 0), F.lit("")).cast("int")


def stable_id(prefix: str, value: Text) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.md5(blank(value).cast("binary")), 1, 12))


def record_key(doi: Text, arxiv: Text, title: Text) -> Column:
    d, a = normalize_doi(doi), normalize_arxiv(arxiv)
    return F.when(F.length(d) > 0, F.concat(F.lit("doi:"), d)).when(F.length(a) > 0, F.concat(F.lit("arxiv:"), a)).otherwise(F.concat(F.lit("title:"), normalize_text(title)))


def year_matches(a: Text, b: Text) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.coalesce(F.abs(x - y) <= 1, F.lit(False))


def author_coverage(candidate: Column, canonical: Column) -> Column:
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_text), lambda x: F.length(x) > 0))
    a, b = names(candidate), names(canonical)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def gbt_reference(c: Text) -> Column:
    """A reference in the style of GB/T 7714 as a struct of type_code, title, authors, venue and publication_info; null if it is none."""
    text = F.trim(blank(c))
    mark = F.regexp_extract(text, GBT_TYPE, 0)
    kind = F.regexp_extract(text, GBT_TYPE, 1)
    around = F.split(text, GBT_TYPE, 2)
    head, tail = F.trim(around[0]), F.trim(F.coalesce(F.try_element_at(around, F.lit(2)), F.lit("")))
    dotted = F.contains(head, F.lit(". "))
    first = F.when(dotted, F.substring_index(head, ". ", 1)).otherwise(F.substring_index(head, ".", 1))
    title = F.trim(F.regexp_replace(F.trim(F.substring(head, F.length(first) + F.when(dotted, 3).otherwise(2), F.length(head))), "[.]+$", ""))
    authors = F.filter(F.transform(F.split(F.trim(first), "[,\\x{FF0C}\\x{3001};\\x{FF1B}]"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~F.lower(x).isin("等", "et al", "et al."))
    rest = F.trim(F.regexp_replace(tail, "^[.]+", ""))
    rest = F.when(rest.startswith("//"), F.trim(F.substring(rest, 3, F.length(rest)))).otherwise(rest)
    parts = F.split(rest, "[,\\x{FF0C}]", 2)
    venue = F.trim(F.regexp_replace(F.trim(parts[0]), "[.]+$", ""))
    venue = F.when(kind == "C", F.trim(F.substring_index(venue, ". ", 1))).otherwise(venue)
    listed = kind.isin("J", "N", "C")
    info = F.when(listed, F.regexp_replace(F.trim(F.try_element_at(parts, F.lit(2))), "[.]+$", "")).otherwise(F.regexp_replace(rest, "[.]+$", ""))
    fine = (F.length(mark) > 0) & F.contains(head, F.lit(".")) & (F.length(title) > 0) & (F.size(authors) > 0)
    return F.when(fine, F.struct(kind.alias("type_code"), title.alias("title"), authors.alias("authors"), F.when(listed, venue).otherwise("").alias("venue"), F.nullif(info, F.lit("")).alias("publication_info")))


def looks_like_citation(c: Text) -> Column:
    """At least 20 characters, and an identifier, a year or a publication word."""
    x = collapse(c)
    return (F.length(x) >= 20) & ((F.length(extract_doi(x)) > 0) | x.rlike(YEAR) | F.lower(x).rlike("\\b(?:arxiv|journal|proceedings|press|conference|vol\\.|pp\\.)"))
