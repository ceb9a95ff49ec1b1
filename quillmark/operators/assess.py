"""Whether evidence supports a claim: components of a score, their ensemble, and the decision over the spans of a citation.

A row is a span (text, scope, ord) under a claim. Probabilities of an entailment model (``entail``, ``contra``) and the
score of a reranker (``rerank``) are columns that may be null: without a model only weak support or none can be told.
The spans of a citation meet in one aggregation that keeps the best span by five measures; a CASE decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import rules
from quillmark.operators.support import PRIORITY, heuristic_support

#: Weights and thresholds of the ensemble, and of the decision.
ENSEMBLE = {"entail": 0.45, "rerank": 0.35, "heuristic": 0.20}
PAIR_FLOOR, PAIR_COMBINED, CONTRADICTION_MAX, FALLBACK = 0.25, 0.24, 0.08, 0.42
ENTAIL_STRONG, ENTAIL_WEAK, CONTRA_STRONG, MARGIN, FLOOR, WEAK = 0.55, 0.30, 0.55, 0.05, 0.30, 0.40
#: Risk score and next action of a support verdict.
RISK = {"supported": (0.05, "keep"), "weakly_supported": (0.55, "strengthen_or_rephrase"), "contradicted": (0.98, "remove_or_reverse_claim"), "insufficient_evidence": (0.70, "find_evidence")}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cosine_score(x: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 1) / 2))


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.transform(scores, lambda s: F.exp(s - top) / total)


def normalized(weights: dict[str, Column]) -> dict[str, Column]:
    """Weights without what is negative or null, as shares of their sum (of 1, if that is 0)."""
    clean = {k: F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for k, w in weights.items()}
    total = sum(clean.values(), F.lit(0.0))
    return {k: w / F.when(total == 0, 1.0).otherwise(total) for k, w in clean.items()}


def ensemble(x: DataFrame) -> DataFrame:
    """Adds combined, ok and path from heuristic, heuristic_ok, rerank, rerank_ok, entail, entail_ok and contra."""
    present = {k: F.col(k).isNotNull() for k in ENSEMBLE}
    w = normalized({k: F.when(present[k], v).otherwise(0.0) for k, v in ENSEMBLE.items()})
    combined = sum((F.coalesce(F.col(k), F.lit(0.0)) * w[k] for k in ENSEMBLE), F.lit(0.0))
    x = x.withColumn("combined", combined)
    c, margin = F.col("combined"), F.col("entail") >= F.coalesce("contra", F.lit(0.0)) + 0.05
    by_model = margin & (F.col("entail") >= PAIR_FLOOR) & (c >= PAIR_COMBINED)
    by_words = F.coalesce("heuristic_ok", F.lit(False)) & margin & (F.coalesce("contra", F.lit(0.0)) <= CONTRADICTION_MAX) & (c >= PAIR_COMBINED)
    paired = F.coalesce("rerank_ok", F.lit(False)) & (by_model | by_words)
    path = (
        F.when(present["entail"] & F.coalesce("entail_ok", F.lit(False)), "nli_pass")
        .when(present["entail"] & present["rerank"] & paired, "paired_reranker_nli")
        .when(present["entail"] & present["rerank"], "paired_reranker_nli_reject")
        .when(present["entail"], "strongest_component")
        .when(c >= FALLBACK, "combined_fallback")
        .otherwise("combined_fallback_reject")
    )
    # without a reranker the strongest component decides; the model has failed, so only words can be it
    words = F.coalesce("heuristic_ok", F.lit(False)) & (F.col("heuristic") > F.col("entail"))
    ok = F.when(path == "strongest_component", words).otherwise(path.isin("nli_pass", "paired_reranker_nli", "combined_fallback"))
    return x.withColumns({"path": path, "ok": ok})


def evidence_scope(field: Column, url: Column) -> Column:
    f = F.lower(F.coalesce(field, F.lit("")))
    has_url = F.length(F.coalesce(url, F.lit(""))) > 0
    return (
        F.when(field == "none", "none").when(f == "title", "title").when(f.startswith("abstract"), "abstract")
        .when(f.rlike("full_text|fulltext|full-text"), "full_text").when(has_url, "metadata_snippet")
        .when(f.startswith("metadata") | F.contains(f, F.lit("chunk")), "metadata").otherwise("unknown")
    )


#: Names of sources, by the first word of a field or a part of a host.
SOURCES = {"openalex": "openalex", "crossref": "crossref", "arxiv": "arxiv", "semantic": "semantic_scholar", "semanticscholar": "semantic_scholar", "s2": "semantic_scholar", "fixture": "fixture"}


def evidence_source(field: Column, url: Column) -> Column:
    f = F.lower(F.trim(F.coalesce(field, F.lit(""))))
    u = F.coalesce(url, F.lit(""))
    host = F.replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), F.lit("-"), F.lit(""))
    out = F.when(f.isin("", "none"), "none").when((f == "title") | f.startswith("abstract"), "citation_metadata")
    out = out.when(F.contains(f, F.lit("user_full_text")) | f.startswith("user_provided"), "user_provided").when(f.startswith("eval_"), "eval_fixture")
    first = F.replace(F.substring_index(f, "_", 1), F.lit("-"), F.lit(""))
    for word, name in SOURCES.items():
        out = out.when(first == word, name)
    for word, name in SOURCES.items():
        out = out.when(F.contains(host, F.lit(word)), name)
    return out.when(F.length(u) > 0, "remote_metadata").when(f.startswith("metadata") | F.contains(f, F.lit("chunk")), "metadata").otherwise("unknown")


def scored_spans(spans: DataFrame, claim: str = "claim", text: str = "text") -> DataFrame:
    """Adds score (of the ensemble, or of the words alone), anchor, explicit and bound to spans with entail and contra."""
    x = rules.evaluate(heuristic_support(spans, claim, text), claim, text)
    x = x.withColumn("explicit", rules.explicit_confidence(F.col("shared"), F.col("coverage"), F.col("prec"), F.col("score"), F.col("contradicts"), F.col("outage")))
    related = ((F.col("shared") >= 2) & (F.col("coverage") >= 0.25)) | ((F.col("shared") >= 3) & (F.col("prec") >= 0.15))
    x = x.withColumn("anchor", F.when(F.col("score") > 0, F.col("score")).when(related, 0.18).otherwise(0.0))
    both = F.col("entail").isNotNull()
    whole = (ENSEMBLE["entail"] * F.col("entail") + ENSEMBLE["heuristic"] * F.col("score")) / (ENSEMBLE["entail"] + ENSEMBLE["heuristic"])
    return x.withColumn("score", F.when(both, whole).otherwise(F.col("score")))


def _weak(s: str, model: bool) -> Column:
    """Whether a span can be called weak support."""
    anchor, e, c = F.col(f"{s}.anchor"), F.col(f"{s}.entail"), F.col(f"{s}.contra")
    words = (F.col(f"{s}.score") >= WEAK) & (anchor >= 0.12)
    if model:
        near = F.when(e.isNotNull() & (c >= e + MARGIN), False).when(e.isNotNull() & (e >= ENTAIL_WEAK) & (e >= c + MARGIN), True).otherwise(words)
    else:
        near = words
    return F.coalesce((anchor > 0) & (((F.col(f"{s}.scope") == "title") & (anchor >= 0.25)) | near), F.lit(False))


def assess(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, confidence, engine, scope, ord) from ``scored_spans``: one row for each claim and citation that has spans."""
    prio = F.coalesce(F.create_map(*(v for k, p in PRIORITY.items() for v in (F.lit(k), F.lit(p))))[F.col("scope")], F.lit(0))
    x = spans.withColumns({"e": F.coalesce("entail", F.lit(0.0)), "c": F.coalesce("contra", F.lit(0.0)), "bound": F.col("boundary").cast("int")})
    body = F.struct("ord", "scope", "score", "anchor", "entail", "contra", "explicit", "bound")
    top = lambda m, when=None: F.max_by(body if when is None else F.when(when, body), F.struct(m, prio, -F.col("ord")) if when is None else F.when(when, F.struct(m, prio, -F.col("ord"))))
    g = x.groupBy(*keys).agg(
        top("score").alias("best"), top("e").alias("ent"), top("c", F.col("score") >= FLOOR).alias("con"), top("explicit").alias("exp"), top("bound").alias("bnd"), F.count("entail").alias("judged")
    )
    model = F.col("judged") > 0
    entail, against = F.coalesce("ent.entail", F.lit(0.0)), F.coalesce("ent.contra", F.lit(0.0))
    contra = F.coalesce("con.contra", F.lit(0.0))
    direct = F.col("ent.scope").isin("metadata_snippet", "full_text") & (entail >= 0.40) & (entail >= against + MARGIN) & (F.col("ent.anchor") >= 0.18)
    by_model, by_words = model & _weak("ent", True), _weak("best", False)
    weak_e = F.when(by_model, F.greatest(entail, F.col("ent.score"), F.col("ent.anchor")))
    weak_w = F.when(by_words, F.when(model, F.greatest("best.score", "best.anchor")).otherwise(F.col("best.score")))
    cases = [
        (model & (F.col("exp.explicit") >= CONTRA_STRONG), "contradicted", F.col("exp.explicit"), "exp"),
        (model & (F.col("bnd.bound") == 1) & (F.col("bnd.scope") != "full_text"), "insufficient_evidence", F.lit(0.8), "bnd"),
        (model & (entail >= ENTAIL_STRONG) & (entail >= against + MARGIN), "supported", entail, "ent"),
        (model & (contra >= CONTRA_STRONG), "contradicted", contra, "con"),
        (model & direct, "supported", entail, "ent"),
        (by_model & (~by_words | (weak_e >= weak_w)), "weakly_supported", weak_e, "ent"),
        (by_words, "weakly_supported", weak_w, "best"),
    ]
    chosen = F.struct(F.lit("insufficient_evidence").alias("verdict"), (1 - F.col("best.score")).alias("confidence"), F.col("best.scope").alias("scope"), F.col("best.ord").alias("ord"))
    for cond, verdict, conf, span in reversed(cases):
        chosen = F.when(cond, F.struct(F.lit(verdict).alias("verdict"), conf.cast("double").alias("confidence"), F.col(f"{span}.scope").alias("scope"), F.col(f"{span}.ord").alias("ord"))).otherwise(chosen)
    out = g.withColumn("x", chosen)
    return out.select(*keys, "x.verdict", F.round("x.confidence", 4).alias("confidence"), F.when(model, "ensemble").otherwise("heuristic").alias("engine"), "x.scope", "x.ord")


def check_claims(claims: DataFrame, resolved: DataFrame, assessed: DataFrame) -> DataFrame:
    """(query_id, citation, verdict, confidence, engine): a citation that is not resolved, or ambiguous, or without spans, is insufficient with confidence 0."""
    x = claims.join(resolved, "citation", "left").join(assessed, ["query_id", "citation"], "left")
    found = F.coalesce(F.col("resolution").isin("verified", "metadata_mismatch", "matched"), F.lit(False))
    use = found & F.col("verdict").isNotNull()
    return x.select("query_id", "citation", F.when(use, F.col("verdict")).otherwise("insufficient_evidence").alias("verdict"), F.when(use, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(use, F.col("engine")).otherwise("none").alias("engine"))


def aggregate_scope(scopes: Column) -> Column:
    """Of the distinct scopes of a set: itself if there is one."""
    s = F.array_distinct(scopes)
    return F.when(F.size(s) == 0, "none").when(F.size(s) == 1, F.try_element_at(s, F.lit(1))).when(F.array_contains(s, "full_text"), "mixed_with_full_text").otherwise("mixed")


def set_details(members: DataFrame, key: str) -> DataFrame:
    """(key, indexes, scope, risk_score, next_action): positions by verdict, in order, and what the set's verdict calls for."""
    x = members.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "verdict", "scope"))).alias("m"))
    at = lambda v: F.array_join(F.transform(F.filter("m", lambda s: s["verdict"] == v), lambda s: s["idx"].cast("string")), ",").alias(v)
    has = lambda v: F.exists("m", lambda s: s["verdict"] == v)
    verdict = F.when(has("contradicted"), "contradicted").when(has("supported"), "supported").when(has("weakly_supported"), "weakly_supported").otherwise("insufficient_evidence")
    risk = F.when(verdict == "contradicted", 0.98).when(verdict == "supported", 0.05).when(verdict == "weakly_supported", 0.60).otherwise(0.72)
    return x.select(key, *(at(v) for v in RISK), aggregate_scope(F.transform("m", lambda s: s["scope"])).alias("scope"), verdict.alias("verdict"), risk.alias("risk_score"))


def verdict_counts(results: DataFrame) -> DataFrame:
    """All four verdicts, with zeros."""
    every = results.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, RISK))).alias("verdict"))
    return every.join(results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
