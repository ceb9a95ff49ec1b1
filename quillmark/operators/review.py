"""Review of ranked results: queues and steps, suggested fixes, places in the sources, what a filter leaves out, release blockers, overcalls.

Results may be many, so a queue is never one list: counts cover all its rows and ids are shown for the first ``SHOWN`` in ranked order
(worst first, then by index), which Spark keeps as a top-k for each queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.evaluate import SLICES, buckets, share, slices

SHOWN = 10
#: Queue of each next action.
QUEUES = {
    "continue": "safe_to_keep_indexes",
    "keep": "safe_to_keep_indexes",
    "keep_claim": "safe_to_keep_indexes",
    "rewrite_or_replace_evidence": "rewrite_or_replace_indexes",
    "resolve_identifier_or_replace": "identity_resolution_indexes",
    "resolve_citation_identity": "identity_resolution_indexes",
    "disambiguate_identifier": "identity_resolution_indexes",
    "review_metadata": "metadata_review_indexes",
    "review_counterevidence_leads": "evidence_review_indexes",
    "tighten_claim_or_inspect_full_text": "evidence_review_indexes",
    "inspect_full_text_or_find_stronger_citation": "evidence_review_indexes",
    "inspect_source_health": "source_retry_indexes",
    "retry_or_check_source_health": "source_retry_indexes",
    "fix_configuration": "input_repair_indexes",
    "provide_missing_input": "input_repair_indexes",
    "repair_input": "input_repair_indexes",
    "install_or_configure_dependency": "input_repair_indexes",
}
#: Priority and action of each queue; the last is not reviewed.
STEPS = {
    "input_repair_indexes": (1, "repair_input"),
    "rewrite_or_replace_indexes": (2, "rewrite_or_replace_evidence"),
    "identity_resolution_indexes": (3, "resolve_identity"),
    "source_retry_indexes": (4, "retry_or_check_source_health"),
    "metadata_review_indexes": (5, "review_metadata"),
    "evidence_review_indexes": (6, "review_evidence"),
    "safe_to_keep_indexes": (7, "keep"),
}
KEEP = "safe_to_keep_indexes"
#: Kind of the suggested fix of each verdict, and whether a user must confirm it.
FIXES = {"metadata_mismatch": ("review_metadata_correction", True), "ambiguous": ("disambiguate_citation", True), "not_found": ("add_identifier_or_replace", True), "verified": ("keep", False)}
RETRY = ("retry_or_check_source_health", "inspect_source_health")
#: Types of cases where an overcall weighs most, and risk score of each slice of overcalls.
HIGH_RISK_TYPES = ("contradiction", "contradiction_set", "hard_negative", "full_text_required")
SLICE_RISK = {"contradiction": 100, "hard_negative": 95, "full_text_boundary": 90, "test_split": 85, "non_english": 80}
#: Severity that an error bucket gives a case.
BLOCKING = {"false_support": "critical", "missed_contradiction": "high", "weak_false_support": "high", "supported_rejected": "medium", "incorrect_abstention": "medium"}


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a small fixed table, null for unknown keys."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in pairs.items() for v in kv)), key)


def ranked_order() -> Column:
    return F.struct((-F.col("risk_score")).alias("s"), F.col("idx").alias("i"))


def shown(x: DataFrame, keys: list[str], value: str, name: str, most: int = SHOWN) -> DataFrame:
    """keys and the first ``most`` values in ranked order, joined by commas."""
    first = x.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("risk_score"), "idx"))).where(F.col("__r") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__r", F.col(value).cast("string").alias("v")))), lambda s: s["v"])
    return first.groupBy(*keys).agg(F.array_join(listed, ",").alias(name))


def queued(items: DataFrame) -> DataFrame:
    """Items (idx, risk, risk_score, next_action, ...) with their queue; actions without one have none."""
    return items.withColumn("queue", lookup(QUEUES, F.col("next_action")))


def steps(items: DataFrame) -> DataFrame:
    """A row for each queue that holds something: priority, action, count, first items."""
    x = queued(items).where(F.col("queue").isNotNull())
    n = x.groupBy("queue").agg(F.count(F.lit(1)).alias("n"))
    y = n.join(shown(x, ["queue"], "idx", "first_ten"), "queue")
    return y.select(lookup({q: p for q, (p, _) in STEPS.items()}, F.col("queue")).alias("priority"), lookup({q: a for q, (_, a) in STEPS.items()}, F.col("queue")).alias("action"), "queue", "n", "first_ten")


def triage(items: DataFrame) -> DataFrame:
    """One row: status, first queue, next action (of the worst item in that queue) and counts; also for no items at all."""
    x = queued(items)
    rank = F.coalesce(lookup({q: p for q, (p, _) in STEPS.items()}, F.col("queue")), F.lit(len(STEPS) + 1))
    per = x.withColumn("p", rank).groupBy("p", "queue").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("next_action", ranked_order()).alias("act"), F.count_if(F.col("risk") == "high").alias("high"), F.count_if(F.col("risk") == "medium").alias("medium")
    )
    reviewed = F.col("p") < len(STEPS)
    g = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(reviewed, F.col("n"))), F.lit(0)).alias("n_review"), F.coalesce(F.sum(F.when(F.col("queue") == KEEP, F.col("n"))), F.lit(0)).alias("n_keep"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("n_high"), F.coalesce(F.sum("medium"), F.lit(0)).alias("n_medium"),
        F.min_by(F.when(reviewed, F.col("queue")), F.when(reviewed, F.col("p"))).alias("q"), F.min_by(F.when(reviewed, F.col("act")), F.when(reviewed, F.col("p"))).alias("a"),
    )
    clear = (F.col("n_review") == 0) & (F.col("n_high") == 0) & (F.col("n_medium") == 0)
    some = F.col("total") > 0
    return g.select(
        F.when(clear, "clear").otherwise("review_required").alias("status"),
        F.when(clear, F.when(some, KEEP).otherwise("")).otherwise(F.coalesce("q", F.lit(""))).alias("first_queue"),
        F.when(clear, F.when(some, "keep").otherwise("continue")).otherwise(F.coalesce("a", F.lit("continue"))).alias("next_action"),
        "total", "n_review", "n_keep", "n_high", "n_medium",
    )


def with_fix(items: DataFrame) -> DataFrame:
    """Adds the kind of fix and whether a user must confirm it: a failed source is asked again, else the verdict decides."""
    retry = F.col("next_action").isin(*RETRY)
    kind = F.when(retry, RETRY[0]).otherwise(F.coalesce(lookup({v: k for v, (k, _) in FIXES.items()}, F.col("verdict")), F.lit("keep")))
    asks = ~retry & F.coalesce(lookup({v: c for v, (_, c) in FIXES.items()}, F.col("verdict")), F.lit(False))
    return items.withColumn("fix_kind", kind).withColumn("confirm", asks)


def fix_summary(items: DataFrame) -> DataFrame:
    """By kind of fix: how many, how many to confirm, the first of them. No fix is ever applied without a user."""
    x = with_fix(items)
    n = x.groupBy("fix_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("confirm").alias("n_confirm"))
    return n.join(shown(x, ["fix_kind"], "idx", "first_ten"), "fix_kind")


def traceability(items: DataFrame) -> DataFrame:
    """By source file and format of the items that name one: counts by risk, and the first locators to review. Blank and ``none`` name nothing."""
    named = lambda c: F.nullif(F.when(F.lower(F.trim(c)) == "none", "").otherwise(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    x = items.withColumns({c: named(c) for c in ("source_path", "source_format", "source_locator")})
    x = x.where(F.coalesce("source_path", "source_format", "source_locator").isNotNull()).na.fill("", ["source_path", "source_format"])
    review = F.col("risk").isin("high", "medium")
    keys = ["source_path", "source_format"]
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(review).alias("n_review"), F.count_if(F.col("risk") == "high").alias("n_high"))
    places = shown(x.where(review & F.col("source_locator").isNotNull()), keys, "source_locator", "locators")
    return n.join(places, keys, "left").na.fill("", ["locators"])


def omitted_summary(items: DataFrame) -> DataFrame:
    """What a report of high risks only leaves out, by risk and next action."""
    rest = items.where(F.coalesce(F.col("risk") != "high", F.lit(True)))
    keys = ["risk", "next_action"]
    return rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(shown(rest, keys, "idx", "first_ten"), keys)


def blocker_severity(bucket_list: Column) -> Column:
    level = lambda s: F.exists(bucket_list, lambda b: lookup(BLOCKING, b) == s)
    return F.when(level("critical"), "critical").when(level("high"), "high").when(level("medium"), "medium").otherwise("low")


def release_blockers(cases: DataFrame) -> DataFrame:
    """One row of an evaluation: cases that block a release or need a review, and the next action."""
    errors = F.filter(buckets(), lambda b: b != "correct_abstention")
    s = cases.select(errors.alias("b")).where(F.size("b") > 0).select(blocker_severity(F.col("b")).alias("s"))
    n = lambda *v: F.count_if(F.col("s").isin(*v))
    g = s.agg(n("critical").alias("n_critical"), n("critical", "high").alias("n_blocking"), n("critical", "high", "medium").alias("n_review"))
    action = (
        F.when(F.col("n_critical") > 0, "block_release_until_false_support_reviewed").when(F.col("n_blocking") > 0, "block_release_until_high_risk_reviewed")
        .when(F.col("n_review") > 0, "review_medium_risk_before_benchmark_claims").otherwise("continue")
    )
    return g.select("*", (F.col("n_blocking") > 0).alias("release_blocked"), (F.col("n_review") == 0).alias("claim_safe"), action.alias("next_action"))


def _overcalled(cases: DataFrame) -> DataFrame:
    b = buckets()
    return cases.withColumn("bucket", F.when(F.array_contains(b, "false_support"), "false_support").when(F.array_contains(b, "weak_false_support"), "weak_false_support")).where("bucket is not null")


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("bucket") == "false_support").alias("n_false"), F.count_if(F.col("bucket") == "weak_false_support").alias("n_weak")]


def overcall_slices(cases: DataFrame) -> DataFrame:
    """Risk slices of support overcalls that are not empty; they overlap."""
    x = _overcalled(cases).select("bucket", F.explode(slices()).alias("slice")).groupBy("slice").agg(*_counts())
    return x.select("slice", lookup({k: v[0] for k, v in SLICES.items()}, F.col("slice")).alias("severity"), lookup(SLICE_RISK, F.col("slice")).alias("risk_score"), lookup({k: v[1] for k, v in SLICES.items()}, F.col("slice")).alias("action"), "n", "n_false", "n_weak")


def overcall_facets(cases: DataFrame, facets: list[str]) -> DataFrame:
    """Support overcalls by facet and value, and how many of them are of high risk."""
    high = F.col("case_type").isin(*HIGH_RISK_TYPES) | (F.col("gold") == "contradicted") | (F.col("split") == "test") | ~F.coalesce("lang", F.lit("")).isin("", "en")
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.nullif(f, F.lit("")), F.lit("unknown")).alias("value")) for f in facets))
    x = _overcalled(cases).select("bucket", high.alias("high"), F.explode(pairs).alias("k"))
    return x.groupBy("k.facet", "k.value").agg(*_counts(), F.count_if("high").alias("n_high_risk"))


def release_summary(blockers: DataFrame, guard: DataFrame, maturity: DataFrame) -> DataFrame:
    """One row from three of one row each. Labels are mature if some are reviewed, some by two annotators, and none of high risk is unreviewed
    (``maturity``: reviewed, dual, published, high_risk_unreviewed)."""
    x = blockers.crossJoin(guard.select(F.col("status").alias("guard"))).crossJoin(maturity)  # one row each
    mature = (F.col("reviewed") > 0) & (F.col("dual") > 0) & (F.col("published") > 0) & (F.col("high_risk_unreviewed") == 0)
    accept = F.col("guard") != "blocked"
    status = (
        F.when(F.col("release_blocked"), "blocked").when(~mature, "evaluation_passed_but_labels_immature")
        .when((F.col("guard") != "clear") | (F.col("n_review") > 0), "review_required").otherwise("clear")
    )
    own = F.col("next_action") != "continue"
    action = F.when(status == "evaluation_passed_but_labels_immature", "complete_human_label_review").when(own, F.col("next_action")).when(status == "review_required", "review_support_eval_before_benchmark_claims").otherwise("continue")
    return x.select(status.alias("status"), action.alias("next_action"), (F.col("claim_safe") & mature).alias("benchmark_claim_safe"), (accept & mature).alias("ok_to_accept_supported"), mature.alias("labels_mature"))


def trigger_metrics(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: confusion and rates of yes/no predictions (id, triggered) of cases (id, expected); how many of either have no partner."""
    p = predictions.select("id", F.col("triggered"))
    x = cases.select("id", "expected").join(p, "id", "full_outer")
    e, t = F.coalesce("expected", F.lit(False)), F.coalesce("triggered", F.lit(False))
    both = F.col("expected").isNotNull() & F.col("triggered").isNotNull()
    n = lambda c: F.count_if(both & c)
    g = x.agg(n(e & t).alias("tp"), n(~e & ~t).alias("tn"), n(~e & t).alias("fp"), n(e & ~t).alias("fn"), F.count_if(F.col("triggered").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("unknown"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rates = {"accuracy": (tp + tn, tp + tn + fp + fn), "prec": (tp, tp + fp), "positive_recall": (tp, tp + fn), "negative_recall": (tn, tn + fp), "f1": (2 * tp, 2 * tp + fp + fn)}
    return g.select("*", *(share(a, b).alias(k) for k, (a, b) in rates.items()))


def baselines(cases: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """One row for each backend, from one pass: its predictions against gold."""
    pairs = F.array(*(F.struct(F.lit(k).alias("backend"), v.alias("pred")) for k, v in predictions.items()))
    x = cases.select("gold", F.explode(pairs).alias("k")).select("gold", "k.*")
    g, p, n, all_ = F.col("gold"), F.col("pred"), F.count_if, F.count(F.lit(1))
    return x.groupBy("backend").agg(
        all_.alias("n"), share(n(g == p), all_).alias("accuracy"), share(n((p == "supported") & (g == "supported")), n(p == "supported")).alias("supported_precision"),
        share(n((p == "supported") & (g != "supported")), n(g != "supported")).alias("false_support_rate"), share(n(p == "insufficient_evidence"), all_).alias("abstention_rate"),
    )


def bucket_scores(scored: DataFrame, scores: list[str]) -> DataFrame:
    """Means of the scores in each error bucket, and the decision paths that lead there (bucket, path, n, means); null path is ``unknown``."""
    x = scored.withColumn("bucket", F.explode(buckets())).withColumn("path", F.coalesce(F.nullif("path", F.lit("")), F.lit("unknown")))
    return x.groupBy("bucket", "path").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(s), 4).alias(f"avg_{s}") for s in scores))


def provenance(claims: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each claim (claim): action (``missing`` without a decision) and risk, the citations tried, and of its findings (claim,
    citation, passed, score) those of the selected citations, or all where none is selected: how many, passed, best score."""
    d = decisions.select("claim", "action", "risk_score", F.coalesce("selected", F.array().cast("array<long>")).alias("selected"))
    x = claims.select("claim").join(d, "claim", "left").join(findings.select("claim", "citation", "passed", "score"), "claim", "left")
    picked = F.col("citation").isNotNull() & (F.coalesce(F.size("selected"), F.lit(0)).isin(-1, 0) | F.array_contains("selected", F.col("citation")))
    g = x.groupBy("claim").agg(
        F.first("action", ignorenulls=True).alias("action"), F.first("risk_score", ignorenulls=True).alias("risk_score"), F.first("selected", ignorenulls=True).alias("selected"),
        F.countDistinct("citation").alias("attempts"), F.count_if(picked).alias("n_findings"), F.count_if(picked & F.col("passed")).alias("n_passed"), F.max(F.when(picked, F.round("score", 4))).alias("best"),
    )
    cites = F.array_join(F.transform(F.coalesce("selected", F.array().cast("array<long>")), lambda c: c.cast("string")), ",")
    return g.select("claim", F.coalesce("action", F.lit("missing")).alias("action"), F.coalesce("risk_score", F.lit(1.0)).alias("risk_score"), cites.alias("citations"), "attempts", "n_findings", "n_passed", "best")


def markdown(rows: DataFrame) -> DataFrame:
    """A line of the audit report for each row of ``provenance``."""
    return rows.select("claim", F.format_string("- %s: action=%s, risk=%.3f, citations=[%s]", F.col("claim").cast("string"), "action", "risk_score", "citations").alias("line"))
