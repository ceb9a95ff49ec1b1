r"""More registered queries: review of ranked results, release reports, parsed citations, cache exports, files of manuscripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import audit, evaluate, extract, records, review
from quillmark.plans.catalogue import _BUCKET, _RISKS, _arxiv, _doi, _query
from quillmark.sources import adapters as A

# ---- review of ranked results -----------------------------------------------------------------------------------


def _case(pairs: dict, column: str, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


_QUEUED = f"""{_RISKS}, q AS (SELECT *, {_case(review.QUEUES, "next_action", "NULL")} AS queue, {_case({k: v[0] for k, v in review.FIXES.items()}, "verdict", "'keep'")} AS kind0 FROM k),
z AS (SELECT *, next_action IN ('retry_or_check_source_health', 'inspect_source_health') AS retry FROM q)"""
_TEN = "array_to_string(list(idx ORDER BY risk_score DESC, idx)[1:10], ',')"


def _items(spark, sf):
    return audit.risk_items(A.verdicts(spark, sf))


@_query("review_steps", f"WITH {_QUEUED} SELECT CAST({_case({q: p for q, (p, _) in review.STEPS.items()}, 'queue', 'NULL')} AS INTEGER) AS priority, {_case({q: a for q, (_, a) in review.STEPS.items()}, 'queue', 'NULL')} AS action, queue, count(*) AS n, {_TEN} AS first_ten FROM q WHERE queue IS NOT NULL GROUP BY queue")
def review_steps(spark, sf):
    return review.steps(_items(spark, sf))


@_query(
    "triage_plan",
    f"""WITH {_QUEUED}, p AS (SELECT *, {_case({q: p for q, (p, _) in review.STEPS.items()}, 'queue', '8')} AS p FROM q), f AS (SELECT min(p) AS p FROM p WHERE p < 7)
    SELECT CASE WHEN n_review + n_high + n_medium > 0 THEN 'review_required' ELSE 'clear' END AS status, first_queue, next_action, total, n_review, n_keep, n_high, n_medium FROM
    (SELECT count(*) AS total, count(*) FILTER (p.p < 7) AS n_review, count(*) FILTER (p.p = 7) AS n_keep, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium FROM p),
    (SELECT queue AS first_queue, next_action FROM p JOIN f ON p.p = f.p ORDER BY risk_score DESC, idx LIMIT 1)""",
)
def triage_plan(spark, sf):
    return review.triage(_items(spark, sf))


@_query("suggested_fixes", f"WITH {_QUEUED} SELECT CASE WHEN retry THEN 'retry_or_check_source_health' ELSE kind0 END AS fix_kind, count(*) AS n, count(*) FILTER (NOT retry AND verdict <> 'verified') AS n_confirm, {_TEN} AS first_ten FROM z GROUP BY 1")
def suggested_fixes(spark, sf):
    return review.fix_summary(_items(spark, sf))


@_query(
    "source_traceability",
    f"""WITH {_RISKS}, s AS (SELECT *, CASE WHEN idx % 6 = 0 THEN '' ELSE 'paper' || (idx % 9) || '.tex' END AS source_path, CASE WHEN idx % 6 = 0 THEN '' WHEN idx % 9 < 5 THEN 'latex' ELSE 'bibtex' END AS source_format, CASE WHEN idx % 6 = 0 THEN '' ELSE 'paper' || (idx % 9) || '.tex#citation-' || idx END AS loc FROM k)
    SELECT source_path, source_format, count(*) AS n, count(*) FILTER (risk IN ('high', 'medium')) AS n_review, count(*) FILTER (risk = 'high') AS n_high, coalesce(array_to_string((list(loc ORDER BY risk_score DESC, idx) FILTER (risk IN ('high', 'medium')))[1:10], ','), '') AS locators
    FROM s WHERE source_path <> '' GROUP BY ALL""",
)
def source_traceability(spark, sf):
    k = F.col("idx")
    none = k % 6 == 0
    path = F.concat(F.lit("paper"), (k % 9).cast("string"), F.lit(".tex"))
    x = _items(spark, sf).withColumns({
        "source_path": F.when(none, "none").otherwise(path),
        "source_format": F.when(none, "").when(k % 9 < 5, "latex").otherwise("bibtex"),
        "source_locator": F.when(~none, F.concat(path, F.lit("#citation-"), k.cast("string"))),
    })
    return review.traceability(x)


@_query("omitted_review_summary", f"WITH {_RISKS} SELECT risk, next_action, count(*) AS n, {_TEN} AS first_ten FROM k WHERE risk <> 'high' GROUP BY risk, next_action")
def omitted_review_summary(spark, sf):
    return review.omitted_summary(_items(spark, sf))


# ---- release reports --------------------------------------------------------------------------------------------

_J = f"j AS ({A.JUDGED_SQL})"
_B = {k: f"({v})" for k, v in _BUCKET.items()}
_BLOCK = f"""{_J}, s AS (SELECT *, CASE WHEN {_B['false_support']} THEN 'critical' WHEN {_B['missed_contradiction']} OR {_B['weak_false_support']} THEN 'high' WHEN {_B['supported_rejected']} OR {_B['incorrect_abstention']} THEN 'medium' END AS s FROM j),
bl AS (SELECT *, n_blocking > 0 AS release_blocked, n_review = 0 AS claim_safe, CASE WHEN n_critical > 0 THEN 'block_release_until_false_support_reviewed' WHEN n_blocking > 0 THEN 'block_release_until_high_risk_reviewed' WHEN n_review > 0 THEN 'review_medium_risk_before_benchmark_claims' ELSE 'continue' END AS next_action
  FROM (SELECT count(*) FILTER (s = 'critical') AS n_critical, count(*) FILTER (s IN ('critical', 'high')) AS n_blocking, count(*) FILTER (s IS NOT NULL) AS n_review FROM s))"""


@_query("release_blockers", f"WITH {_BLOCK} SELECT * FROM bl")
def release_blockers(spark, sf):
    return review.release_blockers(A.judged(spark, sf))


_RISKY = "case_type IN ('contradiction', 'contradiction_set', 'hard_negative', 'full_text_required')"


@_query(
    "release_summary",
    f"""WITH {_BLOCK}, m AS (SELECT count(*) FILTER (case_id % 4 < 3) AS reviewed, count(*) FILTER (case_id % 4 < 2) AS dual, count(*) FILTER (case_id % 4 = 0) AS published, count(*) FILTER (case_id % 4 = 3 AND {_RISKY}) AS u FROM j),
    g AS (SELECT bool_or({_B['false_support']} AND (gold = 'contradicted' OR case_type IN ('hard_negative', 'full_text_required') OR evidence_scope IN ('full_text', 'mixed_with_full_text') OR split = 'test' OR lang NOT IN ('', 'en'))) AS bad FROM j),
    x AS (SELECT *, reviewed > 0 AND dual > 0 AND published > 0 AND u = 0 AS mature FROM bl, m, g)
    SELECT CASE WHEN release_blocked THEN 'blocked' WHEN NOT mature THEN 'evaluation_passed_but_labels_immature' WHEN n_review > 0 THEN 'review_required' ELSE 'clear' END AS status,
    CASE WHEN NOT release_blocked AND NOT mature THEN 'complete_human_label_review' ELSE next_action END AS next_action, claim_safe AND mature AS benchmark_claim_safe, NOT bad AND mature AS ok_to_accept_supported, mature AS labels_mature FROM x""",
)
def release_summary(spark, sf):
    j = A.judged(spark, sf)
    k, n = F.col("case_id") % 4, F.count_if
    labels = j.agg(n(k < 3).alias("reviewed"), n(k < 2).alias("dual"), n(k == 0).alias("published"), n((k == 3) & F.col("case_type").isin(*review.HIGH_RISK_TYPES)).alias("high_risk_unreviewed"))
    return review.release_summary(review.release_blockers(j), evaluate.acceptance_guard(evaluate.acceptance_slices(j)), labels)


_SLICED = {
    "contradiction": "gold = 'contradicted'", "hard_negative": "case_type = 'hard_negative'", "full_text_boundary": "(case_type = 'full_text_required' OR evidence_scope IN ('full_text', 'mixed_with_full_text'))",
    "test_split": "split = 'test'", "non_english": "lang NOT IN ('', 'en')",
}
_OVER = f"{_J}, o AS (SELECT *, CASE WHEN {_B['false_support']} THEN 'f' WHEN {_B['weak_false_support']} THEN 'w' END AS b FROM j)"
_N = "count(*) AS n, count(*) FILTER (b = 'f') AS n_false, count(*) FILTER (b = 'w') AS n_weak"


@_query("overcall_slices", f"WITH {_OVER}, u AS ({' UNION ALL '.join(f"SELECT '{k}' AS slice, '{evaluate.SLICES[k][0]}' AS severity, {review.SLICE_RISK[k]} AS risk_score, '{evaluate.SLICES[k][1]}' AS action, b FROM o WHERE b IS NOT NULL AND {c}" for k, c in _SLICED.items())}) SELECT slice, severity, risk_score, action, {_N} FROM u GROUP BY ALL")
def overcall_slices(spark, sf):
    return review.overcall_slices(A.judged(spark, sf))


_FACETS = ("case_type", "evidence_scope", "lang", "split")


@_query("overcall_facets", f"WITH {_OVER}, h AS (SELECT *, {_RISKY} OR gold = 'contradicted' OR split = 'test' OR coalesce(lang, '') NOT IN ('', 'en') AS high FROM o WHERE b IS NOT NULL), u AS ({' UNION ALL '.join(f"SELECT '{f}' AS facet, coalesce(nullif({f}, ''), 'unknown') AS value, b, high FROM h" for f in _FACETS)}) SELECT facet, value, {_N}, count(*) FILTER (high) AS n_high_risk FROM u GROUP BY facet, value")
def overcall_facets(spark, sf):
    return review.overcall_facets(A.judged(spark, sf), list(_FACETS))


@_query(
    "queue_summary",
    f"""WITH {_J}, q AS (SELECT *, greatest({", ".join(f"CASE WHEN {_B[k]} THEN {s} ELSE 0 END" for k, s in evaluate.SEVERITY.items())}) AS severity FROM j)
    SELECT severity, count(*) AS n, count(*) FILTER (split = 'test') AS n_test, array_to_string(list(case_id ORDER BY split = 'test' DESC, case_type, case_id)[1:10], ',') AS first_ten FROM q WHERE severity > 0 GROUP BY severity""",
)
def queue_summary(spark, sf):
    return evaluate.queue_summary(evaluate.review_queue(A.judged(spark, sf)))


_T = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 4)"


@_query(
    "trigger_metrics",
    f"""WITH c AS (SELECT doc_id AS id, toxic = 1 AS e FROM labels WHERE toxic IS NOT NULL), p AS (SELECT doc_id AS id, (n_chars % 3 = 0) AS t FROM documents WHERE n_chars IS NOT NULL),
    x AS (SELECT count(*) FILTER (e AND t) AS tp, count(*) FILTER (NOT e AND NOT t) AS tn, count(*) FILTER (NOT e AND t) AS fp, count(*) FILTER (e AND NOT t) AS fn, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unknown FROM c FULL JOIN p ON c.id = p.id)
    SELECT *, {_T("tp + tn", "(tp + tn + fp + fn)")} AS accuracy, {_T("tp", "(tp + fp)")} AS prec, {_T("tp", "(tp + fn)")} AS positive_recall, {_T("tn", "(tn + fp)")} AS negative_recall, {_T("2 * tp", "(2 * tp + fp + fn)")} AS f1 FROM x""",
)
def trigger_metrics(spark, sf):
    cases = A.table(spark, sf, "labels").where("toxic is not null").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("expected"))
    said = A.table(spark, sf, "documents").where("n_chars is not null").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3 == 0).alias("triggered"))
    return review.trigger_metrics(cases, said)


@_query(
    "baseline_comparison",
    f"""WITH {_J}, b AS (SELECT gold, 'model' AS backend, pred FROM j UNION ALL SELECT gold, 'always_supported', 'supported' FROM j UNION ALL SELECT gold, 'always_abstain', 'insufficient_evidence' FROM j)
    SELECT backend, count(*) AS n, {_T("count(*) FILTER (gold = pred)", "count(*)")} AS accuracy, {_T("count(*) FILTER (gold = 'supported' AND pred = 'supported')", "count(*) FILTER (pred = 'supported')")} AS supported_precision,
    {_T("count(*) FILTER (gold <> 'supported' AND pred = 'supported')", "count(*) FILTER (gold <> 'supported')")} AS false_support_rate, {_T("count(*) FILTER (pred = 'insufficient_evidence')", "count(*)")} AS abstention_rate FROM b GROUP BY backend""",
)
def baseline_comparison(spark, sf):
    return review.baselines(A.judged(spark, sf), {"model": F.col("pred"), "always_supported": F.lit("supported"), "always_abstain": F.lit("insufficient_evidence")})


@_query(
    "bucket_scores",
    f"""WITH {_J}, b AS (SELECT *, unnest(list_filter([{", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _B.items())}], lambda x: x IS NOT NULL)) AS bucket, case_id % 64 / 64.0 AS ensemble, case_id % 32 / 32.0 AS entail, CASE case_id % 3 WHEN 0 THEN 'nli_pass' WHEN 1 THEN 'combined_fallback' ELSE 'unknown' END AS path FROM j)
    SELECT bucket, path, count(*) AS n, round(avg(CAST(ensemble AS DOUBLE)), 4) AS avg_ensemble, round(avg(CAST(entail AS DOUBLE)), 4) AS avg_entail FROM b GROUP BY bucket, path""",
)
def bucket_scores(spark, sf):
    k = F.col("case_id")
    x = A.judged(spark, sf).withColumns({"ensemble": k % 64 / 64.0, "entail": k % 32 / 32.0, "path": F.when(k % 3 == 0, "nli_pass").when(k % 3 == 1, "combined_fallback").otherwise("")})
    return review.bucket_scores(x, ["ensemble", "entail"])


# ---- claims, decisions and findings -----------------------------------------------------------------------------

_GRAPH = """cl AS (SELECT DISTINCT doc_id % 97 AS claim FROM documents), de AS (SELECT claim, CASE claim % 3 WHEN 0 THEN 'cite' ELSE 'rewrite' END AS action, CAST(claim % 21 AS DOUBLE) / 20 AS risk_score, CASE WHEN claim % 2 = 0 THEN [claim, claim + 97] ELSE CAST([] AS BIGINT[]) END AS sel FROM cl WHERE claim % 7 <> 0),
fi AS (SELECT doc_id % 97 AS claim, doc_id AS citation, doc_id % 2 = 0 AS passed, CAST(doc_id % 101 AS DOUBLE) / 100 AS score FROM documents),
pv AS (SELECT cl.claim, any_value(coalesce(action, 'missing')) AS action, any_value(coalesce(risk_score, 1.0)) AS risk_score, any_value(coalesce(array_to_string(sel, ','), '')) AS citations, count(DISTINCT citation) AS attempts,
  count(*) FILTER (citation IS NOT NULL AND (coalesce(len(sel), 0) = 0 OR list_contains(sel, citation))) AS n_findings, count(*) FILTER (citation IS NOT NULL AND (coalesce(len(sel), 0) = 0 OR list_contains(sel, citation)) AND passed) AS n_passed,
  max(round(score, 4)) FILTER (coalesce(len(sel), 0) = 0 OR list_contains(sel, citation)) AS best FROM cl LEFT JOIN de ON cl.claim = de.claim LEFT JOIN fi ON cl.claim = fi.claim GROUP BY cl.claim)"""


def _provenance(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 97).alias("claim"))
    claims = d.select("claim").distinct()
    c = F.col("claim")
    picked = F.when(c % 2 == 0, F.array(c, c + 97)).otherwise(F.array().cast("array<long>"))
    decisions = claims.where(c % 7 != 0).select("claim", F.when(c % 3 == 0, "cite").otherwise("rewrite").alias("action"), ((c % 21) / 20.0).alias("risk_score"), picked.alias("selected"))
    found = d.select("claim", F.col("doc_id").alias("citation"), (F.col("doc_id") % 2 == 0).alias("passed"), ((F.col("doc_id") % 101) / 100.0).alias("score"))
    return review.provenance(claims, decisions, found)


@_query("claim_provenance", f"WITH {_GRAPH} SELECT * FROM pv")
def claim_provenance(spark, sf):
    return _provenance(spark, sf)


@_query("audit_markdown", f"WITH {_GRAPH} SELECT claim, '- ' || claim || ': action=' || action || ', risk=' || printf('%.3f', risk_score) || ', citations=[' || citations || ']' AS line FROM pv")
def audit_markdown(spark, sf):
    return review.markdown(_provenance(spark, sf))


# ---- records ----------------------------------------------------------------------------------------------------

_GIVEN = f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'LEE A, WU B, et al. ' || title || '[J]. Some Journal, ' || year || ', 3(2): 1-9.' ELSE title || '. ' || venue || ', ' || year || '. doi:' || doi || ' ' || arxiv_id END AS raw,
  CASE WHEN doc_id % 4 IN (0, 3) THEN title ELSE '' END AS title, CASE WHEN doc_id % 8 = 0 THEN doi ELSE '' END AS doi, CASE WHEN doc_id % 4 = 0 THEN year END AS year, title AS t0 FROM ({A.CORPUS_SQL})"""
_GTITLE = r"trim(regexp_replace(trim(t0), '[.]+$', ''))"
_PARSED = rf"""r AS ({_GIVEN}), g AS (SELECT *, doc_id % 4 = 1 AND {_GTITLE} <> '' AS gbt, regexp_extract(raw, '10\.[0-9]{{4,9}}/[-._;()/:a-zA-Z0-9]+', 0) AS fd, lower(regexp_extract(raw, '(?:arxiv|arXiv):\s*([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?)', 1)) AS fa FROM r),
p AS (SELECT doc_id, CASE WHEN {_doi("doi")} <> '' THEN {_doi("doi")} ELSE {_doi("fd")} END AS doi, CASE WHEN title <> '' THEN title WHEN gbt THEN {_GTITLE} ELSE raw END AS title, title <> '' OR gbt AS title_explicit, CASE WHEN gbt THEN 'gbt7714' ELSE '' END AS reference_format,
  CASE WHEN gbt THEN 'LEE A;WU B' ELSE '' END AS authors, CASE WHEN gbt THEN 'Some Journal' ELSE '' END AS venue, coalesce(year, CAST(nullif(regexp_extract(raw, '\b(?:19|20)[0-9]{{2}}\b', 0), '') AS INTEGER)) AS year FROM g)"""


@_query("parse_citation", f"WITH {_PARSED} SELECT doc_id, doi, title, title_explicit, reference_format, authors, venue, year FROM p")
def parse_citation(spark, sf):
    k = F.col("doc_id") % 4
    c = A.corpus(spark, sf)
    year = F.col("year").cast("string")
    cited = F.concat(F.lit("LEE A, WU B, et al. "), "title", F.lit("[J]. Some Journal, "), year, F.lit(", 3(2): 1-9."))
    plain = F.concat("title", F.lit(". "), "venue", F.lit(", "), year, F.lit(". doi:"), "doi", F.lit(" "), "arxiv_id")
    given = c.select(
        "doc_id", F.when(k == 0, "").when(k == 1, cited).otherwise(plain).alias("raw_text"), F.when(k.isin(0, 3), F.col("title")).otherwise("").alias("title"), F.when(F.col("doc_id") % 8 == 0, F.col("doi")).otherwise("").alias("doi"),
        F.lit("").alias("arxiv_id"), F.when(k == 0, F.col("year")).alias("year"), F.lit("").alias("venue"), F.array().cast("array<string>").alias("authors"),
    )
    return records.parse_citation(given).select("doc_id", "doi", "title", "title_explicit", "reference_format", F.array_join("authors", ";").alias("authors"), "venue", "year")


@_query("local_match")
def local_match(spark, sf):
    return records.local_match(A.candidates(spark, sf), A.corpus(spark, sf))


@_query("record_findings")
def record_findings(spark, sf):
    """Existence and metadata scores of every candidate against the record that its number names."""
    cand = A.candidates(spark, sf).select("cand_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id").alias("cand"))
    rec = A.corpus(spark, sf).select("doc_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id").alias("rec"))
    return records.findings(cand.join(rec, F.col("cand_id") == F.col("doc_id")))


_ROWS = f"""c AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_doi("doi")} END AS d, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_arxiv("arxiv_id")} END AS x, coalesce(source, '') AS s FROM ({A.CORPUS_SQL})),
e AS (SELECT doc_id, lower(coalesce(nullif(d, ''), nullif(x, ''), lower(title) || '::' || lower(coalesce(nullif(s, ''), 'cache')))) AS export_key, title, year, coalesce(nullif(s, ''), 'cache') AS source, d AS doi, unnest(['search:' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), 'lookup:' || lpad(CAST(doc_id AS VARCHAR), 12, '0')]) AS cache_key FROM c)"""


def _entries(spark, sf):
    """Every document cached by a search and by a lookup, as an object or as a list; and rows that hold no record."""
    c = A.corpus(spark, sf)
    none = F.col("doc_id") % 5 == 0
    ident = c.withColumn("d", F.when(none, "").otherwise(audit.normalize_doi("doi"))).withColumn("x", F.when(none, "").otherwise(audit.normalize_arxiv("arxiv_id")))
    rec = F.struct("title", "authors", "year", "venue", F.col("d").alias("doi"), F.col("x").alias("arxiv_id"), F.coalesce("source", F.lit("")).alias("source"))
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    rows = F.array(
        F.struct(F.concat(F.lit("search:"), key).alias("key"), F.to_json(F.array(rec)).alias("value"), F.lit('{"operation":"search","source":"openalex"}').alias("metadata")),
        F.struct(F.concat(F.lit("lookup:"), key).alias("key"), F.to_json(rec).alias("value"), F.lit("").alias("metadata")),
        F.struct(F.concat(F.lit("misc:"), key).alias("key"), F.lit("no json").alias("value"), F.lit(None).cast("string").alias("metadata")),
    )
    x = ident.select("doc_id", F.explode(rows).alias("r"))
    return x.select("r.*", F.timestamp_seconds(F.col("doc_id") % 86400).alias("updated_at"))


@_query("cache_export", f"WITH {_ROWS} SELECT export_key, min_by(title, cache_key) AS title, min_by(year, cache_key) AS year, min_by(source, cache_key) AS source, min_by(doi, cache_key) AS doi, min(cache_key) AS cache_key FROM e GROUP BY export_key")
def cache_export(spark, sf):
    return records.export(_entries(spark, sf), deterministic=True).select("export_key", "title", "year", "source", "doi", "cache_key")


@_query(
    "cache_manifest",
    f"""WITH {_ROWS} SELECT count(*) * 3 AS entries, count(*) AS search, count(*) AS lookup, count(*) AS other, count(*) AS selected_entries, count(*) AS selected_search, CAST(0 AS BIGINT) AS selected_lookup, CAST(0 AS BIGINT) AS selected_other, (SELECT count(DISTINCT export_key) FROM e) AS record_count,
    true AS deterministic, 'manifest_records' AS fixture_format, 'cache_export_replay_fixture' AS provenance_policy FROM c""",
)
def cache_manifest(spark, sf):
    rows = _entries(spark, sf)
    some = records.select_entries(rows, "search", "openalex")
    return records.manifest(rows, some, records.export(some, True), deterministic=True).drop("oldest", "newest")


@_query("corpus_errors", "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'doc' END AS i, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 't' END AS t FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(i) = '' THEN 'citation_id' END, CASE WHEN t = '' THEN 'title' END], lambda x: x IS NOT NULL), ',') AS missing FROM c WHERE trim(i) = '' OR t = ''")
def corpus_errors(spark, sf):
    k = F.col("doc_id")
    x = A.table(spark, sf, "documents").select("doc_id", F.when(k % 9 == 0, " ").otherwise("doc").alias("citation_id"), F.when(k % 6 != 0, "t").alias("title"))
    return records.corpus_errors(x, "doc_id")


@_query("default_claim", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own ' || doc_id ELSE 'the claim' END AS claim, CAST(NULL AS VARCHAR) AS error FROM documents")
def default_claim(spark, sf):
    k = F.col("doc_id")
    x = A.table(spark, sf, "documents").select("doc_id", F.when(k % 3 == 0, F.concat(F.lit(" own "), k.cast("string"))).when(k % 3 == 1, "  ").alias("claim"))
    return records.with_claim(x, "the claim ").withColumn("error", F.col("error").cast("string"))


# ---- label cases ------------------------------------------------------------------------------------------------

_RANKED = f"""{_J}, a AS (SELECT *, CAST(coalesce(nullif(list_position({list(records.TYPE_ORDER)}, case_type), 0) - 1, 8) AS BIGINT) AS type_rank, CAST(coalesce(nullif(list_position({list(records.SPLIT_ORDER)}, split), 0) - 1, 3) AS BIGINT) AS split_rank FROM j)"""


@_query("annotation_packet", f"WITH {_RANKED} SELECT case_id, type_rank, split_rank, sha256(CAST(json_object('case_id', case_id, 'case_type', case_type, 'evidence_scope', evidence_scope, 'lang', lang, 'split', split) AS VARCHAR)) AS digest FROM a ORDER BY type_rank, split_rank, case_id LIMIT 200")
def annotation_packet(spark, sf):
    """The limit is the packet's size."""
    return records.packet(A.judged(spark, sf), 200)


@_query("label_sources", f"WITH {_J} SELECT CASE case_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'maintainer' ELSE 'published' END AS label_source, CASE case_id % 4 WHEN 3 THEN 'not_human_reviewed' WHEN 2 THEN 'single_annotator' ELSE 'dual_annotator_agreed' END AS status, count(*) AS n, count(*) FILTER (case_id % 5 = 0) AS n_located FROM j GROUP BY ALL")
def label_sources(spark, sf):
    k = F.col("case_id")
    x = A.judged(spark, sf).withColumns({
        "label_source": F.when(k % 3 == 0, " ").when(k % 3 == 1, "maintainer").otherwise("published "),
        "status": F.when(k % 4 == 3, "not_human_reviewed").when(k % 4 == 2, "single_annotator").otherwise("dual_annotator_agreed"),
        "source_locator": F.when(k % 5 == 0, "p. 3"),
    })
    return records.label_sources(x)


# ---- manuscripts ------------------------------------------------------------------------------------------------

#: Files of a manuscript of our own: the main file, two parts and a file that no one includes.
FILES = (
    ("main.tex", True, "\\input{parts/one} \\include{gone} \\input{parts/two.tex} \\bibliography{refs, more.bib} \\addbibresource[a=b]{extra}"),
    ("parts/one.tex", False, "\\input{two} \\input{../main} \\input{https://example.org/x}"),
    ("parts/two.tex", False, "two \\bibliography{refs}"),
    ("parts/free.tex", False, "nobody asks"),
)


def _files(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("project"))
    base = F.concat(F.lit("/p"), F.col("project").cast("string"), F.lit("/"))
    return d.select("project", F.explode(F.array(*(F.struct(F.concat(base, F.lit(p)).alias("path"), F.lit(m).alias("main"), F.lit(t).alias("text")) for p, m, t in FILES))).alias("f")).select("project", "f.*")


@_query("tex_parts", "SELECT doc_id AS project, CAST(i AS INTEGER) AS ord, '/p' || doc_id || '/' || ['main.tex', 'parts/one.tex', 'parts/two.tex'][i + 1] AS path FROM documents, (SELECT unnest([0, 1, 2]) AS i)")
def tex_parts(spark, sf):
    return records.tex_parts(_files(spark, sf)).select("project", "ord", "path")


@_query("bibliography_links", "SELECT '/p' || doc_id || '/' || p AS path, CAST(o AS INTEGER) AS ord, '/p' || doc_id || '/' || l AS link FROM documents, (VALUES ('main.tex', 0, 'refs.bib'), ('main.tex', 1, 'more.bib'), ('main.tex', 2, 'extra.bib'), ('parts/two.tex', 0, 'parts/refs.bib')) v(p, o, l)")
def bibliography_links(spark, sf):
    return records.bibliography_links(_files(spark, sf))


@_query("loose_references")
def loose_references(spark, sf):
    """Lists of our own without a heading: items, continuation lines, references that stand alone, and prose between."""
    c = A.corpus(spark, sf)
    one = F.format_string("Some prose of no use.\n\n1. %s, Journal of Things, %s.\n   continued here\n2) Wu, B. Other work. Proceedings of X, 2001.\n\nSmith, A. and Jones, B. A study of it. Nature Review Letters, 1999.\nplain end", "title", F.col("year").cast("string"))
    return extract.explode_with(c.select("doc_id", one.alias("text")), "doc_id", "text", extract.loose_references, "raw_text string, line_start int, line_end int")
