"""Batches of claims, each with one citation or a set of them, audited in one plan.

Items are routed by their mode, expanded to (item, citation), judged together, and folded back to one row for each item under its index.
An item without a claim or without citations gives a row that names the fault, and stops nothing. ``audit.ranked`` puts the rows in the order of their risk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import collapse
from quillmark.operators.assess import aggregate_scope
from quillmark.operators.counter import review_flags, set_review_flags

#: Risk and score of a verdict on one citation, score of one on a set, and what to do next.
SINGLE = {"supported": ("low", 0.05), "weakly_supported": ("medium", 0.55), "contradicted": ("high", 0.98), "insufficient_evidence": ("medium", 0.70)}
SET = {"supported": ("low", 0.05), "weakly_supported": ("medium", 0.60), "contradicted": ("high", 0.98), "insufficient_evidence": ("medium", 0.72)}
UNRESOLVED = ("high", 0.90)
LOST = {"ambiguous": "disambiguate_identifier", "not_found": "resolve_citation_identity"}
NEXT = {"supported": "keep_claim", "weakly_supported": "tighten_claim_or_inspect_full_text", "contradicted": "rewrite_or_replace_evidence", "insufficient_evidence": "inspect_full_text_or_find_stronger_citation"}
Judge = Callable[[DataFrame], DataFrame]


def _of(table: dict, verdict: Column, i: int | None = None) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v if i is None else v[i])))[verdict]


def routed(items: DataFrame) -> DataFrame:
    """idx, claim, citations, input_mode and error ('' if there is none): a set unless there is one citation and no other mode is named."""
    n = F.coalesce(F.array_size("citations"), F.lit(0))
    mode = F.coalesce(F.nullif(F.col("input_mode"), F.lit("")), F.when(n == 1, "citation").otherwise("citation_set"))
    error = F.when(F.length(collapse("claim")) == 0, "missing_claim").when(n == 0, "missing_citation").when(~mode.isin("citation", "citation_set"), "unknown_mode").otherwise("")
    return items.select("idx", collapse("claim").alias("claim"), "citations", mode.alias("input_mode"), error.alias("error"))


def audit_items(items: DataFrame, judge: Judge) -> DataFrame:
    """One row for each of ``items`` (idx, claim, citations, input_mode), by idx.

    ``judge`` gets idx, n (place of the citation), claim and citation, and adds verdict, confidence, scope, engine and resolution. An item in the
    mode of one citation is judged by its first. A row that the judge leaves out counts as insufficient evidence.
    """
    rows = routed(items)
    cited = F.when(F.col("input_mode") == "citation", F.slice("citations", 1, 1)).otherwise(F.col("citations"))
    pairs = rows.where("error = ''").select("idx", "claim", F.posexplode(cited).alias("n", "citation"))
    judged = judge(pairs).select("idx", "n", "verdict", F.col("confidence").cast("double").alias("confidence"), "scope", "engine", "resolution")
    x = pairs.select("idx", "n").join(judged, ["idx", "n"], "left").fillna({"verdict": "insufficient_evidence", "confidence": 0.0, "scope": "none", "engine": "none", "resolution": ""})
    count = lambda v: F.count_if(F.col("verdict") == v)
    best = lambda v: F.max(F.when(F.col("verdict") == v, F.col("confidence")))
    scopes = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("n", "scope")))), lambda s: s["scope"])
    g = x.groupBy("idx").agg(
        count("contradicted").alias("c"), count("supported").alias("s"), count("weakly_supported").alias("w"), best("contradicted").alias("bc"), best("supported").alias("bs"), F.avg(F.when(F.col("verdict") == "weakly_supported", F.col("confidence"))).alias("aw"),
        scopes("contradicted").alias("sc"), scopes("supported").alias("ss"), scopes("weakly_supported").alias("sw"), F.min_by(F.struct("verdict", "confidence", "scope", "engine", "resolution"), "n").alias("one"),
    )
    y = rows.join(g, "idx", "left")
    single, ok = F.col("input_mode") == "citation", F.col("error") == ""
    by = lambda c, s, w, none: F.when(F.col("c") > 0, c).when(F.col("s") > 0, s).when(F.col("w") > 0, w).otherwise(none)
    verdict = F.when(single, F.col("one.verdict")).otherwise(by(F.lit("contradicted"), F.lit("supported"), F.lit("weakly_supported"), F.lit("insufficient_evidence")))
    confidence = F.when(single, F.col("one.confidence")).otherwise(by(F.col("bc"), F.col("bs"), F.col("aw"), F.lit(0.0)))
    scope = F.when(single, F.col("one.scope")).otherwise(by(aggregate_scope(F.col("sc")), aggregate_scope(F.col("ss")), aggregate_scope(F.col("sw")), F.lit("none")))
    how = by(F.lit("contradiction_dominates"), F.when(F.col("s") == 1, "single_strong_support").otherwise("multiple_strong_support"), F.when(F.col("w") == 1, "single_weak_support").otherwise("multiple_weak_support"), F.lit("insufficient_evidence"))
    y = y.withColumns({"verdict": F.when(ok, verdict), "confidence": F.when(ok, F.round(confidence, 4)), "evidence_scope": F.when(ok, scope), "support_mode": F.when(ok & ~single, how)})
    lost = single & (F.col("verdict") == "insufficient_evidence") & F.col("one.resolution").isin("not_found", "ambiguous")
    risk = lambda i: F.when(lost, UNRESOLVED[i]).when(single, _of(SINGLE, F.col("verdict"), i)).otherwise(_of(SET, F.col("verdict"), i))
    flags = F.when(single, review_flags(F.col("verdict"), F.col("one.resolution"), F.col("one.engine"), F.col("one.scope"))).otherwise(set_review_flags(F.col("verdict"), F.col("w")))
    supporting = F.when(ok & ~single, F.col("s") + F.col("w"))
    y = y.withColumns({"risk": risk(0), "risk_score": risk(1), "next_action": F.when(lost, _of(LOST, F.col("one.resolution"))).otherwise(_of(NEXT, F.col("verdict"))), "supporting": supporting, "contradicting": F.when(ok & ~single, F.col("c")), "f": F.when(ok, flags)})
    return y.select("idx", "input_mode", "error", "verdict", "confidence", "risk", "risk_score", "support_mode", "supporting", "contradicting", "evidence_scope", "next_action", "f.counterevidence_review", "f.counterevidence_reason")
