"""Rules, support decisions, scored resolution and extraction against plain versions of their definitions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmark.functions.text import STOPWORDS, normalize_text
from quillmark.operators import assess, evaluate, extract, resolve, rules

#: claim, evidence, the rules that fire
PAIRS = [
    ("Pruning improves speed", "Pruning did not improve speed", ["en_improvement_denial"]),
    ("Pruning improves speed", "Pruning improves speed", []),
    ("A seed is always required", "A seed is optional", ["en_necessity_denial"]),
    ("A seed may help", "A seed is optional", []),
    ("The survey supports it", "The survey fails  to support it", ["en_support_denial"]),
    ("The survey does not support it", "The survey does not support it", []),
    ("A match is the final verdict", "A match must not be treated as a verdict", ["en_verdict_classification_denial"]),
    ("The tool flags it as fabricated", "The tool did not flag it as fabricated", ["en_fabrication_denial"]),
    ("See the complete criteria", "Criteria are available in the full-text", ["full_text_boundary_en"]),
    ("An adjudicated benchmark", "Cases are maintainer authored", ["human_review_provenance_boundary"]),
    ("A missing source proves it is fake", "A missing source is not proof that it is fake", ["source_outage_safety"]),
    ("模型一定更好", "模型未必更好", ["zh_universal_denial"]),
    ("训练提高了精度", "训练后精度下降", ["zh_improvement_denial"]),
    ("文章支持该说法", "文章不支持该说法", ["zh_support_denial"]),
    ("文章不支持该说法", "文章不支持该说法", []),
    ("给出完整附录", "摘要仅作说明", ["full_text_boundary_zh"]),
    ("基准已人工标注", "基准为维护者合成", ["human_review_provenance_boundary_zh"]),
    ("来源失败证明论文是伪造", "来源失败不能证明论文是伪造", ["source_outage_safety"]),
    (None, "", []),
]


def test_every_rule_fires_and_stays_silent(spark):
    df = spark.createDataFrame([(i, c, e) for i, (c, e, _) in enumerate(PAIRS)], "i long, claim string, evidence string")
    got = {r["i"]: r for r in rules.evaluate(df, "claim", "evidence").collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        assert got[i]["fired"] == want
        assert got[i]["contradicts"] == any(r.family == "contradiction" for r in rules.RULES if r.name in want)
    assert {n for _, _, want in PAIRS for n in want} == {r.name for r in rules.RULES}


def test_normalize_text_is_the_same_with_and_without_ideographs(spark):
    texts = ["Hello,  World! é", "漢字 A-B c　d", "", None, "\tx\n", "ß½²٣", "a" * 50 + "漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(t):
        kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or "一" <= c <= "鿿" else " " for c in (t or "").lower())
        return " ".join(kept.split(" ")).strip() if "  " not in kept else " ".join(x for x in kept.split(" ") if x)

    assert [r[0] for r in df.select(normalize_text("t")).collect()] == [plain(t) for t in texts]


def decide(spans):
    """The decision list, read off its description, on one citation's spans (in order)."""
    prio = {"full_text": 5, "abstract": 4, "metadata_snippet": 3, "metadata": 2, "title": 1}
    top = lambda key, some=spans: max(some, key=lambda s: (key(s), prio.get(s["scope"], 0), -s["ord"]), default=None)
    model = any(s["entail"] is not None for s in spans)
    e, c = (lambda s: s["entail"] or 0.0), (lambda s: s["contra"] or 0.0)

    def weak(s, with_model):
        if s["anchor"] <= 0:
            return False
        if s["scope"] == "title" and s["anchor"] >= 0.25:
            return True
        if with_model and s["entail"] is not None:
            if c(s) >= e(s) + 0.05:
                return False
            if e(s) >= 0.30 and e(s) >= c(s) + 0.05:
                return True
        return s["score"] >= 0.40 and s["anchor"] >= 0.12

    best = top(lambda s: s["score"])
    if model:
        ent, exp, bnd = top(e), top(lambda s: s["explicit"]), top(lambda s: s["boundary"])
        near = [s for s in spans if s["score"] >= 0.30]
        con = top(c, near)
        if exp["explicit"] >= 0.55:
            return "contradicted", exp["explicit"]
        if bnd["boundary"] and bnd["scope"] != "full_text":
            return "insufficient_evidence", 0.8
        if e(ent) >= 0.55 and e(ent) >= c(ent) + 0.05:
            return "supported", e(ent)
        if con and c(con) >= 0.55:
            return "contradicted", c(con)
        if ent["scope"] in ("metadata_snippet", "full_text") and e(ent) >= 0.40 and e(ent) >= c(ent) + 0.05 and ent["anchor"] >= 0.18:
            return "supported", e(ent)
        found = [max(e(ent), ent["score"], ent["anchor"])] if weak(ent, True) else []
        found += [max(best["score"], best["anchor"])] if weak(best, False) else []
        if found:
            return "weakly_supported", max(found)
    elif weak(best, False):
        return "weakly_supported", best["score"]
    return "insufficient_evidence", 1 - best["score"]


def test_assess_equals_the_decision_list(spark):
    rng = random.Random(5)
    rows, by = [], {}
    for q in range(400):
        spans = []
        for i in range(rng.randint(1, 5)):
            r = lambda: round(rng.random() ** rng.choice((1, 3)), 2)
            model = q % 4 > 0 and rng.random() < 0.9
            spans.append({"ord": i, "scope": rng.choice(("title", "abstract", "full_text", "metadata_snippet", "other")), "score": r(), "anchor": rng.choice((0.0, r(), 0.18)), "entail": r() if model else None, "contra": r() if model else None, "explicit": rng.choice((0.0,) * 6 + (0.6,)), "boundary": rng.random() < 0.1})
        by[q] = decide(spans)
        rows += [(q, *(s[k] for k in ("ord", "scope", "score", "anchor", "entail", "contra", "explicit", "boundary"))) for s in spans]
    df = spark.createDataFrame(rows, "query_id long, ord int, scope string, score double, anchor double, entail double, contra double, explicit double, boundary boolean")
    got = {r["query_id"]: (r["verdict"], r["confidence"]) for r in assess.assess(df, ["query_id"]).collect()}
    assert {v for v, _ in by.values()} == {"supported", "weakly_supported", "contradicted", "insufficient_evidence"}
    assert {q: v for q, (v, _) in got.items()} == {q: v for q, (v, _) in by.items()}
    assert all(abs(got[q][1] - by[q][1]) < 1e-4 for q in by)


def test_ensemble_paths_and_scores(spark):
    rows = [
        (0, 0.5, True, None, None, 0.9, True, 0.0, "nli_pass", True), (1, 0.5, True, 0.9, True, 0.3, False, 0.05, "paired_reranker_nli", True), (2, 0.0, False, 0.9, False, 0.3, False, 0.0, "paired_reranker_nli_reject", False),
        (3, 0.9, True, 0.8, True, None, None, None, "combined_fallback", True), (4, 0.1, False, None, None, None, None, None, "combined_fallback_reject", False), (5, 0.6, True, None, None, 0.2, False, 0.9, "strongest_component", True),
    ]
    df = spark.createDataFrame([r[:8] for r in rows], "i long, heuristic double, heuristic_ok boolean, rerank double, rerank_ok boolean, entail double, entail_ok boolean, contra double")
    got = {r["i"]: r for r in assess.ensemble(df).collect()}
    for r in rows:
        assert (got[r[0]]["path"], got[r[0]]["ok"]) == r[8:]
        have = {k: v for k, v in (("heuristic", r[1]), ("rerank", r[3]), ("entail", r[5])) if v is not None}
        total = sum(assess.ENSEMBLE[k] for k in have)
        assert abs(got[r[0]]["combined"] - sum(v * assess.ENSEMBLE[k] / total for k, v in have.items())) < 1e-12
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "s array<double>").select(assess.softmax(F.col("s")).alias("p"), assess.sigmoid(F.lit(0.0)).alias("g"), assess.cosine_score(F.lit(-0.5)).alias("c")).first()
    assert abs(sum(one["p"]) - 1) < 1e-12 and one["p"][2] > one["p"][0] and (one["g"], one["c"]) == (0.5, 0.25)


RECORDS = [
    (1, "Deep nets for parsing text", ["A B", "C D"], 2019, "ACL", "10.1234/one", "", False), (2, "Deep nets for parsing texts", ["A B"], 2023, "ACL", "", "2001.00001v2", False),
    (3, "A study of birds", ["E F"], 2001, "Birds", "10.1234/three", "", False), (4, "A study of birds", ["E F"], 2001, "Birds", "10.1234/four", "", False), (5, "Quiet oceans", ["G H"], 2010, "Sea", "10.65215/x", "", True), (6, "Loud rivers of the north", ["I J"], 1999, "Water", "", "", False),
]
CITED = [
    (10, "Deep nets for parsing text", ["A B"], 2019, "ACL", "10.1234/ONE", ""), (11, "Deep nets for parsing text", ["A B"], 2019, "", "", ""), (12, "A study of birds", ["E F"], 2001, "", "", ""), (13, "Loud river of the north", ["I J"], 2000, "Water", "", ""),
    (14, "Loud rivers of the north", ["X Y"], 1999, "Water", "", ""), (15, "Nothing like it at all", [], None, "", "", ""), (16, "Quiet oceans", ["G H"], 2010, "", "", ""), (17, "Something else", ["Q"], 2002, "", "10.1234/three", ""), (18, "Loud rivers of the north", ["I J"], 1999, "", "10.9999/none", ""), (19, "", [], None, "", "", ""),
]


def test_verify_equals_brute_force(spark):
    cand = spark.createDataFrame(CITED, "cand_id long, title string, authors array<string>, year int, venue string, doi string, arxiv_id string")
    corpus = spark.createDataFrame(RECORDS, "doc_id long, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, suspect boolean")
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    sim = lambda a, b: SequenceMatcher(None, norm(a), norm(b)).ratio() if norm(a) and norm(b) else 0.0
    got = {r["cand_id"]: r for r in resolve.verify(cand, corpus).collect()}
    for i, title, authors, year, venue, doi, arxiv in CITED:
        hit = next((r for r in RECORDS if doi and r[5].lower() == doi.lower()), None)

        def score(r):
            if doi and r[5].lower() == doi.lower():
                return 1.0
            shared = len({norm(a) for a in authors} & {norm(a) for a in r[2]}) / len(authors) if authors else 0.0
            return 0.70 * sim(title, r[1]) + 0.18 * shared + 0.12 * (year is not None and abs(year - r[3]) <= 1)

        tok = lambda t: set(norm(t).split()) - set(STOPWORDS)
        over = {r[0]: len(tok(title) & tok(r[1])) / max(len(tok(title)), 1) for r in RECORDS}
        near = sorted((r for r in RECORDS if over[r[0]]), key=lambda r: (-(0.6 * over[r[0]] + 0.4 * sim(title, r[1])), r[0]))[: resolve.SEARCH]
        found = sorted({r[0]: r for r in [*([hit] if hit else []), *near]}.values(), key=lambda r: (-score(r), r[7], r[0]))
        strong = [r[3] for r in found if score(r) >= 0.70]
        if not found or score(found[0]) < 0.70:
            want = "not_found"
        else:
            near_dup = len(found) > 1 and score(found[0]) - score(found[1]) < 0.05 and not doi and not arxiv
            odd = not hit and (len(strong) > 1 and max(strong) - min(strong) > 1 or found[0][7])
            best = found[0]
            shared = len({norm(a) for a in authors} & {norm(a) for a in best[2]}) / len(authors) if authors else 1
            bad = (title and sim(title, best[1]) < 0.9) or shared < 0.5 or (year is not None and abs(year - best[3]) > 1) or (venue and sim(venue, best[4]) < 0.6) or (doi and doi.lower() != best[5].lower())
            want = "ambiguous" if near_dup or odd else "metadata_mismatch" if bad else "verified"
        assert got[i]["verdict"] == want, i
        if want != "not_found":
            assert got[i]["doc_id"] == found[0][0] and abs(got[i]["score"] - score(found[0])) < 1e-4
    assert {r["verdict"] for r in got.values()} == {"verified", "metadata_mismatch", "ambiguous", "not_found"}
    assert resolve.verify(cand.limit(0), corpus).count() == 0


def test_windows_and_pages():
    words = lambda n, x="w": " ".join(f"{x}{i}" for i in range(n))
    assert extract.windows("") == [] and extract.windows("One. Two.") == ["One. Two."]
    long = words(10) + "."
    assert extract.windows(f"Short one. {long} End.", words=4, most=9) == ["Short one.", "w0 w1 w2 w3", "w4 w5 w6 w7", "w8 w9.", "End.", f"Short one. {long} End."]
    two = "A b c. D e f."
    assert extract.windows(two, words=3) == ["A b c.", "D e f.", two]
    page = '<meta name="DC.Description" content="About"><h1>Head</h1><nav><li>Item</li></nav><svg><p>no</p></svg><p>About</p><blockquote>Quote</blockquote><h3>Small</h3><h2>Third</h2>'
    assert extract.html_chunks(page) == [("meta", "About"), ("heading", "Head"), ("heading", "Small"), ("paragraph", "Item"), ("paragraph", "Quote")]
    assert extract.html_chunks(None) == []


def test_bibitems_and_numbering(spark):
    tex = "\\begin{thebibliography}{9}\\bibitem[K]{k1} \\emph{A title of a work}, 2001. % no\n\\bibitem{k2} short\n\\bibitem{k3} A title of a work, 2001.\n\\end{thebibliography} after 1999"
    assert extract.bibitems(tex) == [{"key": "k1", "raw_text": "A title of a work, 2001."}, {"key": "k3", "raw_text": "A title of a work, 2001."}]
    df = extract.explode_with(spark.createDataFrame([(7, tex)], "doc_id long, text string"), "doc_id", "text", extract.bibitems, "key string, raw_text string")
    assert [(r["key"], r["source_index"], r["source_locator"]) for r in extract.numbered(df, "doc_id").collect()] == [("k1", 1, "7#citation-1")]


def test_config_ranking_and_queue(spark):
    rows = [(0.5, 0.3, 0.0, 5, 1, 1, 5, 0.8333, 0.8333, 0.8333), (0.6, 0.3, 0.0, 6, 0, 0, 6, 1.0, 1.0, 1.0), (0.4, 0.3, 0.0, 6, 0, 0, 6, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "w double, threshold double, floor double, tp long, fp long, fn long, tn long, prec double, recall double, f1 double")
    assert [r["w"] for r in evaluate.config_ranking(df, 2).collect()] == [0.4, 0.6]
    queue = spark.createDataFrame([(i, "t", i % 2 == 0, 5) for i in range(30)], "case_id long, case_type string, first boolean, severity int")
    r = evaluate.queue_summary(queue).first()
    assert (r["n"], r["n_test"], r["first_ten"]) == (30, 15, ",".join(map(str, range(0, 20, 2))))


@pytest.mark.parametrize("name", ["assess_support_words", "assess_support_model", "check_claims", "verify_scored", "resolution_outcomes", "bibitem_entries"])
def test_queries_without_sql_cover_their_tables(spark, sf_dir, name):
    from quillmark.plans.catalogue import queries

    out = queries()[name](spark, sf_dir)
    assert out.select(out.columns[0]).distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
