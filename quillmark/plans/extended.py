"""More registered queries: rules, support over texts, scored resolution, acceptance reports, extraction, cache exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import assess, audit, evaluate, extract, resolve, rules
from quillmark.operators.support import heuristic_support
from quillmark.plans.catalogue import _norm, _query, _tok_cjk
from quillmark.sources import adapters as A

# ---- rules ------------------------------------------------------------------------------------------------------

#: Claims and evidence of our own, which meet each other by doc_id.
CLAIMS = (
    "The method improves recall of {s}", "All methods must use {s}", "The study supports {s}", "It is not claimed to support {s}", "Exclusion criteria cover every case of {s}", "Plain words about {s}",
    "A match is the final verdict on {s}", "The tool labels {s} as fabricated", "A source timeout proves that {s} is fabricated", "The benchmark of {s} was independently adjudicated",
    "该方法提升了 {s} 的召回率", "所有样本一定来自 {s}", "研究支持 {s}", "来源不可达证明 {s} 是伪造", "{s} 的基准经过人工评审", "全部排除标准见 {s}",
)
EVIDENCE = (
    "It does not improve results, they are worse for {s}", "This step is optional by default in {s}", "The data do not support {s}", "Details are available in the appendix of {s}", "Nothing is said of {s}",
    "A match must not be presented as a verdict on {s}", "The tool does not label {s} as fabricated", "A timeout of a source is not evidence that {s} is fabricated", "The benchmark of {s} is synthetic",
    "结果没有提升 {s}", "样本未必来自 {s}", "数据不支持 {s}", "来源不可达不能证明 {s} 是伪造", "{s} 由维护者合成", "{s} 未描述排除标准",
)


def _pairs(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("x")).alias("s"))
    pick = lambda xs, e: F.replace(F.element_at(F.array(*map(F.lit, xs)), (e + 1).cast("int")), F.lit("{s}"), F.col("s"))
    k = F.col("doc_id")
    return d.select("doc_id", pick(CLAIMS, k % len(CLAIMS)).alias("claim"), pick(EVIDENCE, F.floor(k / len(CLAIMS)) % len(EVIDENCE)).alias("evidence"))


def _listed(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


_PAIRS = f"""SELECT doc_id, replace({_listed(CLAIMS)}[doc_id % {len(CLAIMS)} + 1], '{{s}}', coalesce(source, 'x')) AS claim,
  replace({_listed(EVIDENCE)}[CAST(floor(doc_id / {len(CLAIMS)}) AS BIGINT) % {len(EVIDENCE)} + 1], '{{s}}', coalesce(source, 'x')) AS evidence FROM documents"""
_RULED = f"""n AS (SELECT doc_id, claim, evidence, {_norm("claim")} AS c, {_norm("evidence")} AS e FROM ({_PAIRS})),
v AS (SELECT *, {rules.family_sql("contradiction", "c", "e")} AS contradicts, {rules.family_sql("boundary", "c", "e")} AS boundary, {rules.family_sql("outage", "c", "e")} AS outage FROM n)"""
_FIRED = ", ".join(f"CASE WHEN {r.claim.sql('c')} AND {r.evidence.sql('e')} THEN '{r.name}' END" for r in rules.RULES)


@_query("rule_registry", f"WITH {_RULED} SELECT doc_id, array_to_string(list_filter([{_FIRED}], lambda x: x IS NOT NULL), ',') AS fired, contradicts, boundary, outage FROM v")
def rule_registry(spark, sf):
    x = rules.evaluate(_pairs(spark, sf), "claim", "evidence")
    return x.select("doc_id", F.array_join("fired", ",").alias("fired"), "contradicts", "boundary", "outage")


_PROBES = " UNION ALL ".join(f"SELECT doc_id, '{role}' AS role, claim || ' {tail}' AS query FROM n WHERE {rules.probe_cue(p, t).sql('c')}" for role, p, t, tail in rules.PROBES)


@_query("counterevidence_probes", f"WITH {_RULED} SELECT doc_id, 'claim_similarity' AS role, claim AS query FROM n UNION ALL {_PROBES}")
def counterevidence_probes(spark, sf):
    return rules.counter_queries(_pairs(spark, sf), "doc_id", "claim")


_SHARED = f"""l AS (SELECT *, list_distinct({_tok_cjk("claim")}) AS a, list_distinct({_tok_cjk("evidence")}) AS b FROM v),
h AS (SELECT *, len(list_intersect(a, b)) AS shared, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(a), 1) AS cov, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(b), 1) AS prc FROM l)"""


@_query(
    "counterevidence_topk",
    f"""WITH {_RULED}, {_SHARED}, s AS (SELECT doc_id, round(least(1.0, 0.55 * cov + 0.35 * CASE WHEN contradicts OR outage THEN 1 ELSE 0 END + 0.10 * (doc_id % 10) / 10.0), 4) AS score,
      CASE WHEN outage THEN 'source_outage_safety_cue' WHEN contradicts THEN 'explicit_contradiction_cue' ELSE 'related_candidate' END AS signal FROM h)
    SELECT doc_id, score, signal FROM s WHERE score > 0""",
)
def counterevidence_topk(spark, sf):
    x = rules.counter_evidence(_pairs(spark, sf), "claim", "evidence", (F.col("doc_id") % 10) / 10.0)
    return x.select("doc_id", "score", "signal")


@_query(
    "explicit_contradiction",
    f"""WITH {_RULED}, {_SHARED} SELECT doc_id, CASE WHEN (shared >= 2 AND cov >= 0.25 OR shared >= 3 AND prc >= 0.15 OR outage) AND (contradicts OR outage)
    THEN round(least(0.85, greatest(0.58, 0.50 + 0.40 * cov + 0.20 * prc)), 4) ELSE 0.0 END AS confidence FROM h""",
)
def explicit_contradiction(spark, sf):
    x = rules.evaluate(heuristic_support(_pairs(spark, sf), "claim", "evidence"), "claim", "evidence")
    return x.select("doc_id", rules.explicit_confidence(F.col("shared"), F.col("coverage"), F.col("prec"), F.lit(0.0), F.col("contradicts"), F.col("outage")).alias("confidence"))


# ---- support over texts -----------------------------------------------------------------------------------------


def _spans(spark, sf, model: bool):
    """Each claim with three pieces of evidence: of its own document and of the two next kinds, in scopes of their own."""
    x = _pairs(spark, sf)
    d = x.select("doc_id", "claim", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(scope).alias("scope")) for i, scope in enumerate(("title", "abstract", "metadata_snippet"))))).alias("p"))
    kinds = F.array(*map(F.lit, EVIDENCE))
    piece = F.when(F.col("p.ord") == 0, F.concat(F.lit("On "), "claim")).otherwise(F.replace(F.element_at(kinds, ((F.col("doc_id") + F.col("p.ord") * 7) % len(EVIDENCE) + 1).cast("int")), F.lit("{s}"), F.col("claim")))
    rows = d.select(F.col("doc_id").alias("query_id"), F.lit(0).cast("long").alias("citation"), "p.ord", "p.scope", "claim", piece.alias("text"))
    prob = lambda m: ((F.col("query_id") * m + F.col("ord") * 29) % 101) / 101.0 if model else F.lit(None).cast("double")
    return assess.scored_spans(rows.withColumns({"entail": prob(37), "contra": prob(53)}))


@_query("assess_support_words")
def assess_support_words(spark, sf):
    return assess.assess(_spans(spark, sf, False), ["query_id", "citation"])


@_query("assess_support_model")
def assess_support_model(spark, sf):
    return assess.assess(_spans(spark, sf, True), ["query_id", "citation"])


@_query("support_verdict_counts")
def support_verdict_counts(spark, sf):
    return assess.verdict_counts(assess_support_model(spark, sf))


@_query("check_claims")
def check_claims(spark, sf):
    """Support of every claim by a citation that is resolved first: what resolution cannot tell is insufficient."""
    verdicts = resolve.verify(A.candidates(spark, sf), _corpus(spark, sf)).select(F.col("cand_id").alias("query_id"), F.col("verdict").alias("resolution"))
    assessed = assess_support_model(spark, sf)
    claims = assessed.select("query_id", F.col("query_id").alias("citation"))
    found = verdicts.select(F.col("query_id").alias("citation"), "resolution")
    return assess.check_claims(claims, found, assessed.withColumn("citation", F.col("query_id")))


_FIELD = "['title', 'abstract_2', 'openalex_full_text', 'crossref_meta_1', 'metadata_chunk', 'none', 's2_note', 'user_provided_3'][doc_id % 8 + 1]"
_URL = "['', 'https://arxiv.org/abs/1', 'https://www.semantic-scholar.org/x', 'https://example.org/'][CAST(floor(doc_id / 8) AS BIGINT) % 4 + 1]"


@_query(
    "evidence_provenance",
    f"""WITH f AS (SELECT doc_id, {_FIELD} AS f, {_URL} AS u FROM documents), h AS (SELECT *, replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '-', '') AS host FROM f)
    SELECT doc_id, CASE WHEN f = 'none' THEN 'none' WHEN f = 'title' THEN 'title' WHEN f LIKE 'abstract%' THEN 'abstract' WHEN regexp_matches(f, 'full_text|fulltext|full-text') THEN 'full_text' WHEN u <> '' THEN 'metadata_snippet'
      WHEN f LIKE 'metadata%' OR contains(f, 'chunk') THEN 'metadata' ELSE 'unknown' END AS scope,
    CASE WHEN f = 'none' THEN 'none' WHEN f = 'title' OR f LIKE 'abstract%' THEN 'citation_metadata' WHEN f LIKE 'user_provided%' THEN 'user_provided' WHEN f LIKE 'openalex%' THEN 'openalex' WHEN f LIKE 'crossref%' THEN 'crossref' WHEN f LIKE 's2%' THEN 'semantic_scholar'
      WHEN contains(host, 'arxiv') THEN 'arxiv' WHEN contains(host, 'semantic') THEN 'semantic_scholar' WHEN u <> '' THEN 'remote_metadata' WHEN f LIKE 'metadata%' OR contains(f, 'chunk') THEN 'metadata' ELSE 'unknown' END AS source_name FROM h""",
)
def evidence_provenance(spark, sf):
    k = F.col("doc_id")
    one = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), (e + 1).cast("int"))
    f = one(["title", "abstract_2", "openalex_full_text", "crossref_meta_1", "metadata_chunk", "none", "s2_note", "user_provided_3"], k % 8)
    u = one(["", "https://arxiv.org/abs/1", "https://www.semantic-scholar.org/x", "https://example.org/"], F.floor(k / 8) % 4)
    return A.table(spark, sf, "documents").select("doc_id", f.alias("f"), u.alias("u")).select("doc_id", assess.evidence_scope(F.col("f"), F.col("u")).alias("scope"), assess.evidence_source(F.col("f"), F.col("u")).alias("source_name"))


_MEMBERS = f"""m AS (SELECT conv_id, turn AS idx, ['supported', 'weakly_supported', 'insufficient_evidence', 'contradicted', 'insufficient_evidence', 'weakly_supported', 'insufficient_evidence'][(conv_id * 3 + turn * 5) % 7 + 1] AS verdict,
  ['title', 'abstract', 'full_text'][(conv_id + turn) % 3 + 1] AS scope FROM conversations)"""
_IDX = ", ".join(f"coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (verdict = '{v}'), '') AS {v}" for v in assess.RISK)


@_query(
    "support_set_details",
    f"""WITH {_MEMBERS}, g AS (SELECT conv_id, {_IDX}, list_distinct(list(scope)) AS sc, bool_or(verdict = 'contradicted') AS hc, bool_or(verdict = 'supported') AS hs, bool_or(verdict = 'weakly_supported') AS hw FROM m GROUP BY conv_id)
    SELECT conv_id, {", ".join(assess.RISK)}, CASE WHEN len(sc) = 1 THEN sc[1] WHEN list_contains(sc, 'full_text') THEN 'mixed_with_full_text' ELSE 'mixed' END AS scope,
    CASE WHEN hc THEN 'contradicted' WHEN hs THEN 'supported' WHEN hw THEN 'weakly_supported' ELSE 'insufficient_evidence' END AS verdict, CAST(CASE WHEN hc THEN 0.98 WHEN hs THEN 0.05 WHEN hw THEN 0.60 ELSE 0.72 END AS DOUBLE) AS risk_score FROM g""",
)
def support_set_details(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    labels = F.array(*map(F.lit, ("supported", "weakly_supported", "insufficient_evidence", "contradicted", "insufficient_evidence", "weakly_supported", "insufficient_evidence")))
    scopes = F.array(*map(F.lit, ("title", "abstract", "full_text")))
    m = A.table(spark, sf, "conversations").select("conv_id", t.alias("idx"), F.element_at(labels, ((c * 3 + t * 5) % 7 + 1).cast("int")).alias("verdict"), F.element_at(scopes, ((c + t) % 3 + 1).cast("int")).alias("scope"))
    return assess.set_details(m, "conv_id")


# ---- resolution by score ----------------------------------------------------------------------------------------


def _corpus(spark, sf):
    c = A.corpus(spark, sf)
    return c.withColumn("suspect", audit.suspect(F.col("doi"), F.col("n_chars") % 1500, F.col("year"), 2024)).drop("abstract")


@_query("verify_scored")
def verify_scored(spark, sf):
    return resolve.verify(A.candidates(spark, sf), _corpus(spark, sf)).drop("alternatives")


@_query("resolution_outcomes")
def resolution_outcomes(spark, sf):
    x = resolve.outcome(A.candidates(spark, sf), _corpus(spark, sf))
    return x.select("cand_id", "doc_id", F.round("score", 4).alias("score"), "reason", F.array_join(F.transform("alternatives", lambda a: a.cast("string")), ",").alias("alternatives"), "id_kind", "id_status")


# ---- evaluation -------------------------------------------------------------------------------------------------

_J = f"j AS ({A.JUDGED_SQL})"
_OVER = "pred IN ('supported', 'weakly_supported') AND gold NOT IN ('supported', 'weakly_supported')"
_SLICE = {
    "contradiction": "gold = 'contradicted'", "hard_negative": "case_type = 'hard_negative'", "full_text_boundary": "case_type = 'full_text_required' OR evidence_scope IN ('full_text', 'mixed_with_full_text')",
    "test_split": "split = 'test'", "non_english": "lang NOT IN ('', 'en')",
}
_ACC = f"""{_J}, a AS ({" UNION ALL ".join(f"SELECT '{k}' AS slice, '{evaluate.SLICES[k][0]}' AS severity, '{evaluate.SLICES[k][1]}' AS act, count(*) AS n, count(*) FILTER (pred = 'supported' AND gold <> 'supported') AS n_false, count(*) FILTER (pred = 'weakly_supported' AND gold NOT IN ('supported', 'weakly_supported')) AS n_weak FROM j WHERE {v}" for k, v in _SLICE.items())}),
s AS (SELECT *, CASE WHEN n_false > 0 THEN 'blocked' WHEN n_weak > 0 THEN 'review_required' ELSE 'clear' END AS status FROM a)"""


@_query("acceptance_slices", f"WITH {_ACC} SELECT slice, severity, status, n, n_false, n_weak, CASE WHEN status = 'clear' THEN 'continue' ELSE act END AS action FROM s")
def acceptance_slices(spark, sf):
    return evaluate.acceptance_slices(A.judged(spark, sf))


@_query("acceptance_guard", f"WITH {_ACC}, g AS (SELECT count(*) FILTER (status = 'clear') AS n_clear, count(*) FILTER (status = 'review_required') AS n_review, count(*) FILTER (status = 'blocked') AS n_blocked FROM s) SELECT *, CASE WHEN n_blocked > 0 THEN 'blocked' WHEN n_review > 0 THEN 'review_required' ELSE 'clear' END AS status FROM g")
def acceptance_guard(spark, sf):
    return evaluate.acceptance_guard(evaluate.acceptance_slices(A.judged(spark, sf)))


@_query("support_overcall", f"WITH {_J} SELECT count(*) AS n, count(*) FILTER ({_OVER}) AS support_overcall_count, round(CAST(count(*) FILTER ({_OVER}) AS DOUBLE) / greatest(count(*) FILTER (gold NOT IN ('supported', 'weakly_supported')), 1), 4) AS support_overcall_rate FROM j")
def support_overcall(spark, sf):
    return evaluate.support_metrics_all(A.judged(spark, sf)).select("n", "support_overcall_count", "support_overcall_rate")


_FACETS = ("case_type", "evidence_scope", "lang", "split")


@_query("abstention_facets", f"WITH {_J}, f AS ({' UNION ALL '.join(f"SELECT '{f}' AS facet, coalesce(nullif({f}, ''), 'unknown') AS value, gold FROM j WHERE pred = 'insufficient_evidence'" for f in _FACETS)}) SELECT facet, value, count(*) FILTER (gold = 'insufficient_evidence') AS n_right, count(*) FILTER (gold <> 'insufficient_evidence') AS n_wrong FROM f GROUP BY ALL")
def abstention_facets(spark, sf):
    return evaluate.abstention(A.judged(spark, sf), list(_FACETS))


_V = "v AS (SELECT ['verified', 'metadata_mismatch', 'not_found', 'ambiguous'][doc_id % 4 + 1] AS gold, ['verified', 'metadata_mismatch', 'not_found', 'ambiguous'][(doc_id + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END) % 4 + 1] AS pred FROM documents)"
_R = lambda a, b: f"round(CASE WHEN count(*) FILTER ({b}) = 0 THEN 0.0 ELSE CAST(count(*) FILTER ({a}) AS DOUBLE) / count(*) FILTER ({b}) END, 4)"


@_query(
    "verification_metrics",
    f"""WITH {_V} SELECT count(*) AS n, {_R("gold = pred", "true")} AS accuracy, {_R("gold = 'not_found' AND pred = 'not_found'", "pred = 'not_found'")} AS fabrication_precision, {_R("gold = 'not_found' AND pred = 'not_found'", "gold = 'not_found'")} AS fabrication_recall,
    {_R("gold = 'metadata_mismatch' AND pred = 'metadata_mismatch'", "pred = 'metadata_mismatch'")} AS metadata_error_precision, {_R("gold = 'metadata_mismatch' AND pred = 'metadata_mismatch'", "gold = 'metadata_mismatch'")} AS metadata_error_recall,
    {_R("gold = 'verified' AND pred = 'not_found'", "gold = 'verified'")} AS false_accusation_rate FROM v""",
)
def verification_metrics(spark, sf):
    names = F.array(*map(F.lit, A.VERDICTS))
    k = F.col("doc_id")
    x = A.table(spark, sf, "documents").select(F.element_at(names, (k % 4 + 1).cast("int")).alias("gold"), F.element_at(names, ((k + F.when(k % 5 == 0, 2).otherwise(0)) % 4 + 1).cast("int")).alias("pred"))
    return evaluate.verification_metrics(x)


@_query("review_coverage_by_slice", f"WITH {_J} SELECT lang, case_type, count(*) AS n, count(*) FILTER (case_id % 3 = 0) AS n_reviewed, round(CAST(count(*) FILTER (case_id % 3 = 0) AS DOUBLE) / count(*), 4) AS coverage FROM j GROUP BY CUBE (lang, case_type)")
def review_coverage_by_slice(spark, sf):
    return evaluate.review_coverage(A.judged(spark, sf), F.col("case_id") % 3 == 0)


# ---- records, pages and manuscripts -----------------------------------------------------------------------------


@_query("record_completeness", f"SELECT doc_id, (title <> '')::INT + (len(authors) > 0)::INT + (year IS NOT NULL)::INT + (venue <> '')::INT + (abstract <> '')::INT + (doi <> '')::INT + (arxiv_id <> '')::INT AS completeness FROM ({A.CORPUS_SQL})")
def record_completeness(spark, sf):
    c = A.corpus(spark, sf).withColumn("url", F.lit(""))
    return c.select("doc_id", F.struct("title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "url").alias("rec")).select("doc_id", resolve.completeness8().alias("completeness"))


@_query("bibitem_entries")
def bibitem_entries(spark, sf):
    """``thebibliography`` lists of our own, numbered after repeated texts are dropped."""
    c = A.corpus(spark, sf)
    one = F.format_string("\\begin{thebibliography}{9}\n\\bibitem{a%s} \\emph{%s}, %s, %s. %% note\n\\bibitem[L]{b} Other {Work} on things, 1999.\n\\bibitem{c} other work on things, 1999.\n\\bibitem{d} short\n\\end{thebibliography}", F.col("doc_id").cast("string"), "title", "venue", F.col("year").cast("string"))
    found = extract.explode_with(c.select("doc_id", one.alias("text")), "doc_id", "text", extract.bibitems, "key string, raw_text string")
    return extract.numbered(found, "doc_id").drop("ord")
