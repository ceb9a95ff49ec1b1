"""Operators against brute force, and invariants that any partitioning must keep."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillmark.operators import audit, evaluate, extract, retrieve, similarity, support

DOCS = [(0, "Neural models improve recall"), (1, "Recall of neural neural search"), (2, "Cooking pasta at home"), (3, "")]


def docs(spark, n=2):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(n)


def claims(spark):
    return spark.createDataFrame([(7, "neural recall recall")], "query_id long, q string")


def test_bm25_by_hand_and_any_partitioning(spark):
    tokens = [[t for t in d.lower().split() if t not in ("of", "at")] for _, d in DOCS]
    mean = sum(map(len, tokens)) / len(tokens)
    expected = {}
    for i, ts in enumerate(tokens):
        tf, s = Counter(ts), 0.0
        for t in ["neural", "recall", "recall"]:
            df = sum(t in x for x in tokens)
            s += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean))
        if s > 0:
            expected[i] = round(s, 6)
    for n in (1, 3):
        got = {r["doc_id"]: r["score"] for r in retrieve.bm25(docs(spark, n), "doc_id", "text", claims(spark), "q", 5).collect()}
        assert got == expected


def test_top_k_is_a_prefix_of_the_ranking(spark):
    full = [r["doc_id"] for r in retrieve.cosine(docs(spark), "doc_id", "text", claims(spark), "q", 10).orderBy("rank").collect()]
    assert [r["doc_id"] for r in retrieve.cosine(docs(spark), "doc_id", "text", claims(spark), "q", 1).collect()] == full[:1]


def test_blocked_similarity_equals_brute_force(spark):
    left = ["small red apple", "big green pear", "nothing alike"]
    right = ["small red apples", "large green pear", "zzz"]
    a = spark.createDataFrame(list(enumerate(left)), "cand_id long, title string")
    b = spark.createDataFrame(list(enumerate(right)), "doc_id long, name string")
    got = {(r["cand_id"], r["doc_id"]): r["score"] for r in similarity.blocked_pairs(a, "cand_id", "title", b, "doc_id", "name", 0.6).collect()}
    want = {(i, j): s for i, x in enumerate(left) for j, y in enumerate(right) if (s := SequenceMatcher(None, x, y).ratio()) >= 0.6}
    assert got == want


def test_blocked_similarity_loses_no_pair(spark):
    rng = random.Random(4)
    names = ["cold bolt", "old plate", "", "a", "ab", None, *("".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(60))]
    names += [n[:-1] + "z" for n in names[-30:]]
    a = spark.createDataFrame(list(enumerate(names)), "cand_id long, title string")
    clean = [" ".join((n or "").split()) for n in names]
    for least in (0.3, 0.571, 0.8, 0.9):
        got = {(r["cand_id"], r["doc_id"]): r["score"] for r in similarity.blocked_pairs(a, "cand_id", "title", a.toDF("doc_id", "name"), "doc_id", "name", least).collect()}
        want = {(i, j): s for i, x in enumerate(clean) for j, y in enumerate(clean) if x and y and (s := SequenceMatcher(None, x, y).ratio()) >= least}
        assert got == want, least
        assert least > 0.6 or (0, 1) in got  # no word in common


def test_fuzzy_title_match_compares_all_parts(spark, sf_dir):
    from quillmark.plans import catalogue

    parts = sorted((r["p_partkey"], r["p_name"]) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect())
    names = {n for _, n in parts}
    ratio = {(x, y): SequenceMatcher(None, x, y).ratio() for x in names for y in names}
    want = {}
    for i, x in parts:
        best = sorted((-ratio[x, y], j) for j, y in parts if j != i and ratio[x, y] >= 0.571)[:3]
        want |= {(i, rank): (j, -s) for rank, (s, j) in enumerate(best, 1)}
    got = catalogue.queries()["fuzzy_title_match"](spark, sf_dir)
    assert got.columns == ["cand_id", "doc_id", "title", "name", "score", "rank"]
    assert {(r["cand_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()} == want


def test_cascade_finds_similar_titles(spark):
    records = [(1, "", "", "Deep residual learning for image recognition"), (2, "", "", "Attention is all you need"), (3, "10.1/x", "", "Attention is all you need!"), (4, "", "", "Attention is all we need"), (5, "", "", "")]
    asked = [(1, "", "", "Deep residual lerning for image recogniton"), (2, "", "", "Attention is al you need"), (3, "10.1/X", "", "another title"), (4, "", "", "Attention is all you need"), (5, "", "", "Graph cooking"), (6, "", "", ""), (7, "10.1/none", "", "Deep residual learning of image recognition"), (8, "", "", None)]
    got = {r["cand_id"]: (r["doc_id"], r["method"]) for r in audit.cascade(spark.createDataFrame(asked, "cand_id long, doi string, arxiv_id string, title string"), spark.createDataFrame(records, "doc_id long, doi string, arxiv_id string, title string")).collect()}
    clean = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    for i, _, _, title in asked:
        if i not in (3, 4):
            score, doc = min(((-SequenceMatcher(None, clean(title), clean(t)).ratio() if title and t else 0.0, d) for d, _, _, t in records))
            assert got[i] == ((doc, "similar") if -score >= 0.85 else (None, "none")), i
    assert got[1] == (1, "similar") and got[7] == (1, "similar") and got[3] == (3, "doi") and got[4] == (2, "title")


def test_field_diffs_by_similarity(spark):
    fields = "title: string, authors: array<string>, year: int, venue: string, doi: string, arxiv_id: string"
    pair = [(1, ("Attention is al you need", [], None, "Proc. Neural Systems", "", ""), ("Attention is all you need", [], None, "Proceedings of Neural Systems", "", ""))]
    df = spark.createDataFrame(pair, f"cand_id: long, cand: struct<{fields}>, rec: struct<{fields}>")
    assert {r["field"]: r["matches"] for r in audit.field_diffs(df, similarity.sequence_similarity).collect()} == {"title": True, "venue": True}


def test_verdict_order(spark):
    df = spark.createDataFrame([(None, "", 0), (0.5, "", 0), (0.9, "near_duplicate", 2), (0.9, "", 1), (0.9, "", 0)], "s double, r string, m int")
    assert [r[0] for r in df.select(audit.verdict(F.col("s"), F.col("r"), F.col("m"))).collect()] == ["not_found", "not_found", "ambiguous", "metadata_mismatch", "verified"]


def test_ranked_positions(spark):
    x = spark.createDataFrame([(i, [0.05, 0.65, 0.95][i % 3]) for i in range(20)], "idx long, risk_score double")
    got = [r["idx"] for r in audit.ranked(x).orderBy("position").collect()]
    assert got == sorted(range(20), key=lambda i: (-[0.05, 0.65, 0.95][i % 3], i))


def test_support_set_precedence(spark):
    rows = [(1, "supported", 0.7), (1, "contradicted", 0.6), (2, "weakly_supported", 0.4), (2, "weakly_supported", 0.5), (3, "insufficient_evidence", 0.9)]
    got = {r["c"]: (r["verdict"], r["confidence"]) for r in support.support_set(spark.createDataFrame(rows, "c long, verdict string, confidence double"), "c").collect()}
    assert got == {1: ("contradicted", 0.6), 2: ("weakly_supported", 0.45), 3: ("insufficient_evidence", 0.0)}


def test_contradiction_rules(spark):
    rows = [("It improves recall", "It does not improve recall"), ("You must use it", "It is optional"), ("It supports this", "The data do not support this"), ("It fails to support this", "The data do not support this"), ("It improves recall", "It improves recall")]
    df = spark.createDataFrame(rows, "c string, e string")
    assert [r[0] for r in df.select(support.contradiction(F.col("c"), F.col("e"))).collect()] == [True, True, True, False, False]


def test_metrics_of_empty_and_full(spark):
    none = evaluate.support_metrics(spark.createDataFrame([], "gold string, pred string")).first()
    assert none["n"] == 0 and none["accuracy"] == 0.0
    one = evaluate.support_metrics(spark.createDataFrame([("supported", "supported"), ("contradicted", "supported")], "gold string, pred string")).first()
    assert (one["accuracy"], one["supported_precision"], one["false_support_rate"], one["contradiction_recall"]) == (0.5, 0.5, 1.0, 0.0)


def test_reference_lines():
    text = "# Intro\n- no\n## References\n[1] First,\n  continued.\n\n2. Second\n# Annex\n- not this"
    assert extract.reference_lines(text) == ["First, continued.", "Second"]


def test_bibtex():
    text = '@string{j = "Journal"} @comment{x} @article{k1, title = {A {Nested} T}, journal = j # " B", year = 2020,} @book(k2, title = "Q \\"{o}")'
    first, second = extract.bibtex_entries(text)
    assert (first["key"], first["title"], first["journal"], first["year"]) == ("k1", "A Nested T", "Journal B", "2020")
    assert second["entry_type"] == "book"


def test_windows_and_html():
    assert extract.windows("a b. c d e. " + "x " * 5, 4) == ["a b.", "c d e.", "x x x x", "x"]
    html = '<meta name="description" content="D"><script>no</script><h1>H</h1><p>P one</p><p>P one</p><p>Q<b>x</b></p>'
    assert extract.html_chunks(html) == [("meta", "D"), ("heading", "H"), ("paragraph", "P one"), ("paragraph", "Qx")]
