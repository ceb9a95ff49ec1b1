"""Text and identifier expressions: inputs with the results that follow from their rules."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import ident, text


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f("v").alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_normalize_text(spark):
    assert column(spark, text.normalize_text, ["Hello,  World!", "Étude 42", None, "", "深度学习 Model"]) == ["hello world", "tude 42", "", "", "深度学习 model"]


def test_tokenize(spark):
    assert column(spark, text.tokenize, ["The cat and the cat", "深度学习 x", "学", "", None]) == [["cat", "cat"], ["深度", "度学", "学习", "x"], ["学"], [], []]


def test_sentences_and_snippet(spark):
    assert column(spark, text.split_sentences, ["One. Two! Three", "Single.", "", None]) == [["One.", "Two!", "Three", "One. Two! Three"], ["Single."], [], []]
    assert column(spark, lambda c: text.snippet(c, 10), ["short", "a very long text"]) == ["short", "a very..."]


def test_strip_tags_and_slug(spark):
    assert column(spark, text.strip_tags, ["<b>a</b>&amp;<i>b</i>", None]) == ["a & b", ""]
    assert column(spark, text.slug, ["--A b/c--"]) == ["A-b-c"]


@pytest.mark.parametrize(
    ("raw", "doi"),
    [("https://doi.org/10.1000/ABC.", "10.1000/abc"), ("doi: DOI:10.1/x;", "10.1/x"), ("dx.doi.org/10.5/Y,", "10.5/y"), ("", ""), (None, ""), ("http://dx.doi.org/doi:10.2/z", "10.2/z")],
)
def test_normalize_doi(spark, raw, doi):
    assert column(spark, ident.normalize_doi, [raw]) == [doi]


def test_arxiv(spark):
    raw = ["arXiv: 2001.00001v2", "https://arxiv.org/pdf/2001.00001v1.pdf", "<2001.1234?x=1>", "hep-th/9901001", None]
    assert column(spark, ident.normalize_arxiv, raw) == ["2001.00001v2", "2001.00001v1", "2001.1234", "hep-th/9901001", ""]
    assert column(spark, ident.base_arxiv, raw[:1]) == ["2001.00001"]
    assert column(spark, ident.extract_arxiv, ["see arXiv:1706.03762v7 and 2001.00001", "none"]) == ["1706.03762v7", ""]


def test_extract(spark):
    assert column(spark, ident.extract_doi, ["in 10.1234/Ab.c, 2020", "no"]) == ["10.1234/ab.c", ""]
    assert column(spark, ident.extract_year, ["in 1999 or 2020", "1899"]) == [1999, None]


def test_gbt_reference(spark):
    out = column(spark, ident.gbt_reference, ["CHEN X, LI Y, et al. Some title[J]. Good Journal, 2020, 1(2): 3.", "no marker here"])
    assert (out[0]["title"], out[0]["authors"], out[0]["venue"], out[0]["type_code"]) == ("Some title", ["CHEN X", "LI Y"], "Good Journal", "J")
    assert out[1] is None


def test_authors_and_years(spark):
    df = spark.createDataFrame([(["A. Bee", "C"], ["a bee"], 2020, 2021), ([], ["x"], None, 2020)], "a array<string>, b array<string>, x int, y int")
    rows = df.select(ident.author_coverage(F.col("a"), F.col("b")).alias("c"), ident.year_matches("x", "y").alias("m")).collect()
    assert [(r["c"], r["m"]) for r in rows] == [(0.5, True), (0.0, False)]
