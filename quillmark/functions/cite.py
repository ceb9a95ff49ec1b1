"""Citations as strings: inline, reference, BibTeX and GB/T 7714 forms of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import blank


def _last_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), "\\s+"), -1)


def _given(c: Column) -> Column:
    return F.length(blank(c)) > 0


def _year(year: Column, absent: str) -> Column:
    return F.coalesce(year.cast("string"), F.lit(absent))


def inline(authors: Column, year: Column, title: Column) -> Column:
    """(last name of the first author, or first word of the title; year)."""
    lead = F.when(F.size(authors) > 0, _last_word(F.try_element_at(authors, F.lit(1)))).otherwise(F.split(F.trim(blank(title)), "\\s+")[0])
    return F.concat(F.lit("("), lead, F.lit(", "), _year(year, "n.d."), F.lit(")"))


def reference(authors: Column, year: Column, title: Column, venue: Column) -> Column:
    names = F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise("Unknown Author")
    return F.concat(names, F.lit(" ("), _year(year, "n.d."), F.lit("). "), blank(title), F.lit("."), F.when(_given(venue), F.concat(F.lit(" "), venue, F.lit("."))).otherwise(""))


def escape(c: Column) -> Column:
    """Backslashes, then braces, for BibTeX."""
    x = F.replace(blank(c), F.lit("\\"), F.lit("\\textbackslash{} "))
    return F.replace(F.replace(x, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def bibtex(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    lead = F.regexp_replace(F.lower(F.when(F.size(authors) > 0, _last_word(F.try_element_at(authors, F.lit(1)))).otherwise("")), "[^a-z0-9]+", "")
    word = F.lower(F.regexp_extract(blank(title), "[A-Za-z0-9]+", 0))
    filled = lambda c, absent: F.when(F.length(c) > 0, c).otherwise(absent)
    names = filled(F.array_join(F.transform(authors, lambda a: escape(a)), " and "), "Unknown Author")
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    lines = F.array(
        line("title", escape(title)), line("author", names), line("year", _year(year, "nd")),
        F.when(_given(venue), line("journal", escape(venue))), F.when(_given(doi), line("doi", blank(doi))), F.when(_given(url), line("url", escape(url))),
    )
    return F.concat(F.lit("@article{"), filled(lead, "ref"), _year(year, "nd"), filled(word, "record"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def gbt7714(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    names = F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise("佚名")
    y = _year(year, "日期不详")
    place = F.when(_given(venue), F.concat(F.lit("[J]. "), venue, F.lit(", "), y)).otherwise(F.concat(F.lit("[EB/OL], "), y))
    link = F.when(_given(doi), F.concat(F.lit(". DOI: "), doi)).when(_given(url), F.concat(F.lit(". "), url)).otherwise("")
    return F.concat(names, F.lit(". "), blank(title), place, link, F.lit("."))
