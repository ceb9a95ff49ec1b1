"""Reviews, records, sinks and files of manuscripts against plain versions of their definitions."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmark.functions.text import normalize_text
from quillmark.operators import extract, records, review
from quillmark.plans import catalogue
from quillmark.sources import adapters as A
from quillmark.sources import writers

ITEM = "idx long, verdict string, risk string, risk_score double, next_action string"


def test_triage_of_nothing_of_kept_and_of_mixed_items(spark):
    none = review.triage(spark.createDataFrame([], ITEM)).first()
    assert (none["status"], none["first_queue"], none["next_action"], none["total"]) == ("clear", "", "continue", 0)
    kept = review.triage(spark.createDataFrame([(0, "verified", "low", 0.05, "keep")], ITEM)).first()
    assert (kept["status"], kept["first_queue"], kept["next_action"], kept["n_keep"]) == ("clear", review.KEEP, "keep", 1)
    rows = [(0, "verified", "low", 0.05, "keep"), (1, "metadata_mismatch", "medium", 0.65, "review_metadata"), (2, "not_found", "high", 0.95, "resolve_identifier_or_replace"), (3, "ambiguous", "high", 0.95, "disambiguate_identifier"), (4, None, None, 0.1, "odd")]
    mixed = spark.createDataFrame(rows, ITEM)
    got = review.triage(mixed).first()
    assert (got["status"], got["first_queue"], got["next_action"]) == ("review_required", "identity_resolution_indexes", "resolve_identifier_or_replace")
    assert (got["n_review"], got["n_keep"], got["n_high"], got["n_medium"], got["total"]) == (3, 1, 2, 1, 5)
    assert [(r["priority"], r["n"], r["first_ten"]) for r in review.steps(mixed).orderBy("priority").collect()] == [(3, 2, "2,3"), (5, 1, "1"), (7, 1, "0")]
    assert {r["fix_kind"]: r["n_confirm"] for r in review.fix_summary(mixed).collect()} == {"keep": 0, "review_metadata_correction": 1, "add_identifier_or_replace": 1, "disambiguate_citation": 1}
    assert sum(r["n"] for r in review.omitted_summary(mixed.where("risk is not null")).collect()) == 2


@pytest.mark.parametrize(
    ("labels", "want"),
    [((1, 1, 1, 0), "clear"), ((1, 1, 0, 0), "evaluation_passed_but_labels_immature"), ((1, 1, 1, 2), "evaluation_passed_but_labels_immature")],
)
def test_release_status_of_right_predictions(spark, labels, want):
    case = "case_id long, gold string, pred string, case_type string, lang string, split string, evidence_scope string"
    good = spark.createDataFrame([(1, "supported", "supported", "direct", "en", "dev", "title")], case)
    blockers = review.release_blockers(good)
    assert blockers.first()["next_action"] == "continue"
    maturity = spark.createDataFrame([labels], "reviewed long, dual long, published long, high_risk_unreviewed long")
    assert review.release_summary(blockers, spark.createDataFrame([("clear",)], "status string"), maturity).first()["status"] == want


def test_given_fields_win_over_the_raw_text(spark):
    schema = "i long, raw_text string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string"
    rows = [
        (0, "Zhao L, Qian M. A title. With dots[J]. Acta, 2020, 1(2): 3.", None, None, None, None, None, None),
        (1, "Something of 1999 doi:10.1000/ABC. arXiv:2001.01234v2", "Given", ["N"], 2005, "V", "10.5/x", None),
        (2, "no reference at all", None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
    ]
    got = {r["i"]: r for r in records.parse_citation(spark.createDataFrame(rows, schema)).collect()}
    assert (got[0]["title"], got[0]["authors"], got[0]["venue"], got[0]["year"], got[0]["reference_format"]) == ("A title. With dots", ["Zhao L", "Qian M"], "Acta", 2020, "gbt7714")
    assert (got[1]["title"], got[1]["authors"], got[1]["venue"], got[1]["year"], got[1]["doi"], got[1]["arxiv_id"]) == ("Given", ["N"], "V", 2005, "10.5/x", "2001.01234v2")
    assert (got[2]["title"], got[2]["title_explicit"]) == ("no reference at all", False)
    assert (got[3]["title"], got[3]["title_explicit"], got[3]["year"]) == ("", False, None)
    assert len({r["citation_id"] for r in got.values()}) == 4


def test_local_match_loses_nothing_against_all_pairs(spark, sf_dir):
    keep = F.col("doc_id") < 60
    cand = A.candidates(spark, sf_dir).where(F.col("cand_id") < 60)
    corpus = A.corpus(spark, sf_dir).where(keep)
    norm = lambda df, *extra: df.select(*extra, normalize_text("title").alias("t"), records.normalize_doi("doi").alias("d"), records.base_arxiv("arxiv_id").alias("a"), "year", F.transform("authors", normalize_text).alias("names")).collect()
    recs = norm(corpus, "doc_id")
    want = {}
    for c in norm(cand, "cand_id"):
        scored = []
        for r in recs:
            same = lambda f: 0.6 if c[f] and c[f] == r[f] else 0.0  # noqa: B023, E731
            names = set(c["names"])
            title = SequenceMatcher(None, c["t"], r["t"]).ratio() if c["t"] and r["t"] else 0.0
            score = min(1.0, same("d") + same("a") + 0.25 * title + 0.1 * len(names & set(r["names"])) / len(names) + (0.05 if abs(c["year"] - r["year"]) <= 1 else 0))
            scored.append((score, -r["doc_id"]))
        best = max(scored)
        if best[0] >= 0.7:
            want[c["cand_id"]] = (-best[1], round(best[0], 4))
    got = {r["cand_id"]: (r["doc_id"], r["score"]) for r in records.local_match(cand, corpus).collect()}
    assert want and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    with pytest.raises(ValueError):
        records.local_match(cand, corpus, 0.3)


def test_findings_and_their_halves(spark):
    side = "struct<title:string,authors:array<string>,year:int,venue:string,doi:string,arxiv_id:string>"
    rows = [
        (1, 1, ("A fine title", ["X"], 2000, "", "", ""), ("A fine title", ["X"], 2001, "Y", "", "")),
        (2, 2, ("zzzz", [], None, "V", "10.1234/A", ""), ("qqqq", ["X"], 2001, "V", "10.1234/a", "")),
        (3, 3, (None, None, None, None, None, None), (None, None, None, None, None, None)),
    ]
    got = {r["cand_id"]: r for r in records.findings(spark.createDataFrame(rows, f"cand_id long, doc_id long, cand {side}, rec {side}")).collect()}
    assert (got[1]["existence"], got[1]["metadata"], got[1]["passed"]) == (1.0, 0.925, True)
    assert (got[2]["existence"], got[2]["metadata"], got[2]["passed"]) == (1.0, 0.15, False)
    assert got[3]["metadata"] == 0.075 and not got[3]["passed"]


def test_cache_rows_of_any_shape(spark):
    rows = [
        ("lookup:a", '{"title":"T","doi":"10.1/X","source":"s"}', "", 1), ("search:a", '[{"title":"other","doi":"10.1/x"},{"title":"U"}]', '{"operation":"search","source":"o"}', 2),
        ("search:b", "not json", None, 3), ("search:c", "[]", None, 3), ("odd", None, None, 4), ("zz", '{"title":"u","source":"CACHE"}', '{"operation":"lookup"}', 5),
    ]
    cache = spark.createDataFrame(rows, "key string, value string, metadata string, at long").select("key", "value", "metadata", F.timestamp_seconds("at").alias("updated_at"))
    got = sorted((r["export_key"], r["title"], r["cache_key"], r["cache_updated_at"]) for r in records.export(cache, True).where("title is not null").collect())
    assert got == [("10.1/x", "T", "lookup:a", None), ("u::cache", "U", "search:a", None)]
    assert [r["key"] for r in records.select_entries(cache, "lookup").orderBy("key").collect()] == ["lookup:a", "zz"]
    assert [r["key"] for r in records.select_entries(cache, "search", "o").collect()] == ["search:a"]
    m = records.manifest(cache, cache.limit(0), records.export(cache, True)).first()
    assert (m["entries"], m["search"], m["lookup"], m["other"], m["selected_entries"]) == (6, 3, 1, 2, 0)


def test_files_of_a_manuscript(spark):
    files = spark.createDataFrame([("p", "p/m.tex", r"\input{b}\include{a.tex}\input{none}", True), ("p", "p/a.tex", r"\input{b}", False), ("p", "p/b.tex", r"\input{m} \bibliography{x,,http://h/y} \addbibresource{z.bib}", False), ("q", "m.tex", None, True)], "project string, path string, text string, main boolean")
    parts = [(r["project"], r["ord"], r["path"]) for r in records.tex_parts(files).orderBy("project", "ord").collect()]
    assert parts == [("p", 0, "p/m.tex"), ("p", 1, "p/b.tex"), ("p", 2, "p/a.tex"), ("q", 0, "m.tex")]
    assert [(r["path"], r["ord"], r["link"]) for r in records.bibliography_links(files).orderBy("ord").collect()] == [("p/b.tex", 0, "p/x.bib"), ("p/b.tex", 1, "p/z.bib")]


def test_projects_are_read_in_batches(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    def never(*_, **__):
        raise AssertionError("a call for each project")

    monkeypatch.setattr(GroupedData, "applyInPandas", never)
    rows = [(k, f"{k}/{n}", t, m) for k in range(40) for n, t, m in (("b.tex", r"\input{../%d/c,./a}" % k, True), ("a.tex", r"\include{b} \input{d}", True), ("c.tex", None, False), ("free.tex", "x", None))]
    rows += [(None, "n.tex", "no project", True), (90, "90/a.tex", "no main file", False)]
    files = spark.createDataFrame(rows, "project long, path string, text string, main boolean")
    got = {}
    for r in records.tex_parts(files).orderBy("project", "ord").collect():
        got.setdefault(r["project"], []).append((r["ord"], r["path"], r["text"]))
    text = {(p, f): t for p, f, t, _ in rows}
    assert got == {k: [(i, f"{k}/{n}.tex", text[k, f"{k}/{n}.tex"]) for i, n in enumerate("abc")] for k in range(40)} | {None: [(0, "n.tex", "no project")]}


def test_loose_lists():
    text = "Intro.\n- Lee, A. A long enough title, 2019.\n  and its tail\nplain words\n\\section{x}\nBrown, C. On things. Physical Review, 2011.\n* no cite\n"
    assert extract.loose_references(text) == [("Lee, A. A long enough title, 2019. and its tail", 2, 3), ("Brown, C. On things. Physical Review, 2011.", 6, 6)]
    assert extract.loose_references("") == []


def test_sinks_write_what_they_got(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 2), ("a", "T", 1)], "citation_id string, title string, n int")
    writers.json_lines(df, f"{tmp_path}/lines")
    got = sorted((json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/lines").collect()), key=lambda x: x["n"])
    assert got == [{"citation_id": "a", "n": 1, "title": "T"}, {"citation_id": "b", "n": 2, "title": None}]
    with pytest.raises(Exception, match="lacks title"):
        writers.corpus(df, f"{tmp_path}/bad")
    writers.corpus(df.where("n = 1"), f"{tmp_path}/good")
    assert spark.read.json(f"{tmp_path}/good").first()["title"] == "T"
    writers.frozen_index(df, f"{tmp_path}/index")
    assert {r["citation_id"] for r in spark.read.parquet(f"{tmp_path}/index").collect()} == {"a", "b"}
    base = writers.artifacts(spark, "My Run!", {"m": {"f1": 0.5, "list": [1]}}, {"k": 1}, f"{tmp_path}/runs", "R 1")
    assert base.endswith("runs/my-run/r-1")
    assert json.loads(spark.read.text(f"{base}/manifest").first()[0])["summary"] == {"m.f1": 0.5}
    writers.markdown(df.select("n", F.col("citation_id").alias("line")), "n", f"{tmp_path}/report", "Report")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()} >= {"# Report", "a", "b"}


def test_packet_digests_follow_the_fields(spark):
    schema = "case_id long, case_type string, evidence_scope string, lang string, split string"
    x = spark.createDataFrame([(2, "standard", "t", "en", "train"), (1, "hard_negative", "t", None, "dev"), (3, "what", "t", "en", "test")], schema)
    got = records.packet(x, 2).collect()
    assert [(r["case_id"], r["type_rank"], r["split_rank"]) for r in got] == [(1, 1, 1), (3, 8, 0)]
    assert len({r["digest"] for r in got}) == 2


def test_trigger_metrics_count_those_without_a_partner(spark):
    cases = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, expected boolean")
    said = spark.createDataFrame([(1, True), (2, True), (9, True)], "id long, triggered boolean")
    m = review.trigger_metrics(cases, said).first()
    assert (m["tp"], m["fp"], m["fn"], m["missing"], m["unknown"], m["prec"]) == (1, 1, 0, 1, 1, 0.5)


def test_every_new_query_is_registered():
    assert {"review_steps", "parse_citation", "cache_export", "tex_parts", "release_summary"} <= set(catalogue.queries())
