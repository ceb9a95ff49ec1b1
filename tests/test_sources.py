"""Readers and formatters on small files of our own."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quillmark.functions import cite
from quillmark.sources import readers


def test_citations_and_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"title": "A", "year": "2020"}\n{"venue": "x"}\n')
    rows = readers.citations(spark, f"file://{tmp_path}/c.jsonl").collect()
    assert [r["error"] for r in rows] == [None, "one of raw_text, title, doi, arxiv_id is required"] and rows[0]["year"] == 2020
    (tmp_path / "f.json").write_text(json.dumps({"records": [{"citation_id": "1", "title": "T", "year": 2001, "authors": ["A B"]}, {"title": "U"}]}))
    recs = readers.corpus(spark, f"file://{tmp_path}/f.json").orderBy("title").collect()
    assert recs[0]["citation_id"] == "1" and recs[0]["source"] == "fixture" and recs[1]["citation_id"].startswith("fixture:") and recs[1]["doi"] == ""


def test_inverted_index_and_crossref(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "display_name": "T", "publication_year": 2020, "doi": "https://doi.org/10.1/X", "authorships": [{"author": {"display_name": "A"}}], "primary_location": {"source": {"display_name": "V"}}}
    schema = "id string, display_name string, publication_year int, doi string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"
    (tmp_path / "w.jsonl").write_text(json.dumps(work | {"abstract_inverted_index": {"hello": [0, 2], "world": [1]}}) + "\n")
    r = readers.openalex(spark.read.schema(schema).json(f"file://{tmp_path}/w.jsonl")).first()
    assert (r["abstract"], r["doi"], r["venue"], r["authors"]) == ("hello world hello", "10.1/x", "V", ["A"])


def test_docx_and_atom(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; </w:t><w:t>two</w:t></w:r></w:p><w:p></w:p><w:p a='1'><w:t>Three</w:t></w:p></w:document>")
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.docx(spark, f"file://{tmp_path}/*.docx").collect()}
    assert got == {"a.docx": "One & two\nThree", "b.docx": ""}
    (tmp_path / "x.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2001.00001v2</id><title>A\n title</title><published>2020-01-01</published><author><name>N</name></author></entry></feed>")
    r = readers.arxiv(spark, f"file://{tmp_path}/x.xml").first()
    assert (r["arxiv_id"], r["title"], r["year"], r["authors"]) == ("2001.00001v2", "A title", 2020, ["N"])


def test_allowed_urls(spark):
    urls = ["http://a.com/x", "ftp://a.com", "http://localhost/x", "https://10.0.0.1/", "https://www.sciencedirect.com/a", None, "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(readers.allowed_url(F.col("u")).alias("a"))
    assert [r["a"] for r in df.collect()] == [True, False, False, False, False, False, False]


def test_formats(spark):
    df = spark.createDataFrame([(["Ada B. Cee", "D E"], 2020, "A {b}", "V", "10.1/x"), ([], None, "Title here", "", "")], "a array<string>, y int, t string, v string, d string")
    c = [F.col(x) for x in "aytvd"]
    a, b = df.select(cite.inline(*c[:3]).alias("i"), cite.reference(*c[:4]).alias("r"), cite.bibtex(*c, F.lit("")).alias("b"), cite.gbt7714(*c, F.lit("")).alias("g")).collect()
    assert (a["i"], a["r"]) == ("(Cee, 2020)", "Ada B. Cee, D E (2020). A {b}. V.")
    assert a["b"].startswith("@article{cee2020a,\n  title = {A \\{b\\}},") and "doi = {10.1/x}" in a["b"]
    assert a["g"] == "Ada B. Cee, D E. A {b}[J]. V, 2020. DOI: 10.1/x."
    assert (b["i"], b["r"], b["g"]) == ("(Title, n.d.)", "Unknown Author (n.d.). Title here.", "佚名. Title here[EB/OL], 日期不详.")
