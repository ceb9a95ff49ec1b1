"""Evaluation of predictions: support metrics, confusion, grouped metrics, error buckets, review queue, gates, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("supported", "weakly_supported", "insufficient_evidence", "contradicted")
#: Severity of each error bucket.
SEVERITY = {"false_support": 5, "missed_contradiction": 4, "weak_false_support": 3, "supported_rejected": 2, "incorrect_abstention": 1}


def share(a: Column, b: Column) -> Column:
    """Rounded ratio, 0 where the denominator is."""
    return F.round(F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1))), 4)


def support_metrics(x: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    g, p = F.col("gold"), F.col("pred")
    tp, ps, gs = n((g == "supported") & (p == "supported")), n(p == "supported"), n(g == "supported")
    pos = ("supported", "weakly_supported")
    all_ = F.count(F.lit(1))
    return x.agg(
        all_.alias("n"),
        share(n(g == p), all_).alias("accuracy"),
        share(tp, ps).alias("supported_precision"),
        share(tp, gs).alias("supported_recall"),
        share(2 * tp, ps + gs).alias("supported_f1"),
        share(n((p == "supported") & (g != "supported")), n(g != "supported")).alias("false_support_rate"),
        n(p.isin(*pos) & ~g.isin(*pos)).alias("support_overcall_count"),
        share(n(p == "insufficient_evidence"), all_).alias("abstention_rate"),
        share(n((g == "supported") & p.isin("contradicted", "insufficient_evidence")), gs).alias("misjudged_support_rate"),
        share(n((g == "contradicted") & (p == "contradicted")), n(g == "contradicted")).alias("contradiction_recall"),
    )


def per_label(x: DataFrame) -> DataFrame:
    """Precision, recall and F1 for each of the four labels, rounded each; one pass over the cases."""
    rows = x.select("gold", "pred", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    m = rows.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(p).alias("predicted"), F.count_if(g).alias("gold"))
    return m.select("label", "tp", "predicted", "gold", share(F.col("tp"), F.col("predicted")).alias("prec"), share(F.col("tp"), F.col("gold")).alias("recall"), share(2 * F.col("tp"), F.col("predicted") + F.col("gold")).alias("f1"))


def averages(labels: DataFrame) -> DataFrame:
    """Macro and gold-weighted averages of the rounded per-label values, in whole ten-thousandths: a half is rounded up, whatever the order of the sum."""
    half_up = lambda s, n: F.floor((2 * s + n) / (2 * n)) / 10_000.0
    out = []
    for c in ("prec", "recall", "f1"):
        whole = F.round(F.col(c) * 10_000).cast("long")
        out.append(half_up(F.sum(whole), F.count(F.lit(1))).alias(f"macro_{c}"))
        out.append(half_up(F.sum(whole * F.col("gold")), F.greatest(F.sum("gold"), F.lit(1))).alias(f"weighted_{c}"))
    return labels.agg(*out)


def confusion(x: DataFrame) -> DataFrame:
    return x.groupBy("gold").pivot("pred", list(LABELS)).count().na.fill(0)


def grouped_metrics(x: DataFrame, facets: list[str]) -> DataFrame:
    """Accuracy and abstention for each value of each facet, and overall, in one pass by grouping sets."""
    view = x.select("gold", "pred", *facets)
    sets = [[F.col(f)] for f in facets] + [[]]
    agg = view.groupingSets(sets, *(F.col(f) for f in facets)).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hits"), F.count_if(F.col("pred") == "insufficient_evidence").alias("abstained"))
    facet, value = F.lit("overall"), F.lit("all")
    for i, f in enumerate(facets):
        one = (1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i))
        facet, value = F.when(F.col("gid") == one, f).otherwise(facet), F.when(F.col("gid") == one, F.coalesce(F.nullif(f, F.lit("")), F.lit("unknown"))).otherwise(value)
    return agg.select(facet.alias("facet"), value.alias("value"), "n", share(F.col("hits"), F.col("n")).alias("accuracy"), share(F.col("abstained"), F.col("n")).alias("abstention_rate"))


def buckets() -> Column:
    """Error buckets of a case; they overlap."""
    g, p = F.col("gold"), F.col("pred")
    tests = {
        "false_support": (p == "supported") & (g != "supported"),
        "weak_false_support": (p == "weakly_supported") & ~g.isin("supported", "weakly_supported"),
        "missed_contradiction": (g == "contradicted") & (p != "contradicted"),
        "supported_rejected": (g == "supported") & p.isin("contradicted", "insufficient_evidence"),
        "incorrect_abstention": (p == "insufficient_evidence") & (g != "insufficient_evidence"),
        "correct_abstention": (p == "insufficient_evidence") & (g == "insufficient_evidence"),
    }
    return F.filter(F.array(*(F.when(t, n) for n, t in tests.items())), lambda x: x.isNotNull())


def error_buckets(x: DataFrame) -> DataFrame:
    return x.select(F.explode(buckets()).alias("bucket"), "case_type").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_type").alias("case_types"))


def review_queue(x: DataFrame) -> DataFrame:
    """Cases with an error, worst first; the test split before others, then by type and id."""
    found = x.withColumn("b", F.filter(buckets(), lambda b: b != "correct_abstention")).where(F.size("b") > 0)
    level = F.create_map(*(v for k, s in SEVERITY.items() for v in (F.lit(k), F.lit(s))))
    return found.select("case_id", "case_type", "split", F.array_join("b", ",").alias("buckets"), F.array_max(F.transform("b", lambda b: level[b])).alias("severity"), (F.col("split") == "test").alias("first"))


def integrity(x: DataFrame) -> DataFrame:
    """Means of five booleans and their composite."""
    m = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    p, e, s, u, a = m("phantom"), m("metadata_error"), m("claim_supported"), m("unsupported"), m("abstained")
    ris = 0.25 * (1 - p) + 0.2 * (1 - e) + 0.3 * s + 0.15 * (1 - u) + 0.1 * a
    return x.agg(*(F.round(v, 4).alias(n) for n, v in (("PCR", p), ("MCR", e), ("CSR", s), ("UCR", u), ("AU", a), ("RIS", ris))))


def calibration(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Confusion and F1 of each configuration. Examples are counted by their scores first, so the grid (broadcast: it is a parameter) meets few distinct rows."""
    packed = scored.groupBy("a", "b", "supported").agg(F.count(F.lit(1)).alias("n"))
    x = packed.crossJoin(F.broadcast(grid))
    hit = (F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b") >= F.col("threshold")) & (F.col("a") >= F.col("floor"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    m = x.groupBy("w", "threshold", "floor").agg(total(hit & F.col("supported")).alias("tp"), total(hit & ~F.col("supported")).alias("fp"), total(~hit & F.col("supported")).alias("fn"), total(~hit & ~F.col("supported")).alias("tn"))
    one = F.lit(1)
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return m.select("w", "threshold", "floor", "tp", "fp", "fn", "tn", F.round(p, 4).alias("prec"), F.round(r, 4).alias("recall"), F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), one), 4).alias("f1"))


def facet_caps(x: DataFrame, facet: str, order: list[Column], cap: int) -> DataFrame:
    from pyspark.sql.window import Window

    return x.withColumn("rank", F.row_number().over(Window.partitionBy(facet).orderBy(*order))).where(F.col("rank") <= cap)


#: Slices of the acceptance report, with severity and what to do where one is not clear.
SLICES = {
    "contradiction": ("critical", "inspect_contradiction_before_accepting_support"),
    "hard_negative": ("critical", "rewrite_or_replace_evidence"),
    "full_text_boundary": ("high", "inspect_full_text_or_find_stronger_citation"),
    "test_split": ("high", "block_release_until_reviewed"),
    "non_english": ("high", "review_language_specific_failure"),
}


def slices() -> Column:
    """Names of the slices that a case is in; they overlap."""
    tests = {
        "contradiction": F.col("gold") == "contradicted",
        "hard_negative": F.col("case_type") == "hard_negative",
        "full_text_boundary": (F.col("case_type") == "full_text_required") | F.col("evidence_scope").isin("full_text", "mixed_with_full_text"),
        "test_split": F.col("split") == "test",
        "non_english": ~F.col("lang").isin("", "en"),
    }
    return F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))


def acceptance_slices(x: DataFrame) -> DataFrame:
    """A row for every slice, also where no case is in it: counts, and clear, review_required or blocked."""
    false = (F.col("pred") == "supported") & (F.col("gold") != "supported")
    weak = (F.col("pred") == "weakly_supported") & ~F.col("gold").isin("supported", "weakly_supported")
    g = x.select(F.explode(slices()).alias("slice"), false.alias("f"), weak.alias("w")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("n_false"), F.count_if("w").alias("n_weak"))
    every = x.sparkSession.createDataFrame([(k, *v) for k, v in SLICES.items()], "slice string, severity string, action string")
    y = F.broadcast(every).join(g, "slice", "left").na.fill(0, ["n", "n_false", "n_weak"])  # five rows
    status = F.when(F.col("n_false") > 0, "blocked").when(F.col("n_weak") > 0, "review_required").otherwise("clear")
    return y.select("slice", "severity", status.alias("status"), "n", "n_false", "n_weak", F.when(status == "clear", "continue").otherwise(F.col("action")).alias("action"))


def acceptance_guard(rows: DataFrame) -> DataFrame:
    """One row: how many slices have each status, and the worst of them."""
    n = lambda v: F.count_if(F.col("status") == v)
    g = rows.agg(n("clear").alias("n_clear"), n("review_required").alias("n_review"), n("blocked").alias("n_blocked"))
    return g.withColumn("status", F.when(F.col("n_blocked") > 0, "blocked").when(F.col("n_review") > 0, "review_required").otherwise("clear"))


def support_metrics_all(x: DataFrame) -> DataFrame:
    """The seventeen scalars in one row: those of ``support_metrics``, the overcall rate, and the averages over labels."""
    pos = ("supported", "weakly_supported")
    g, p = F.col("gold"), F.col("pred")
    over = x.agg(share(F.count_if(p.isin(*pos) & ~g.isin(*pos)), F.count_if(~g.isin(*pos))).alias("support_overcall_rate"))
    return support_metrics(x).crossJoin(over).crossJoin(averages(per_label(x)))  # one row each


def verification_metrics(x: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of two verdicts, and the share of real works called not found; of gold and pred."""
    g, p = F.col("gold"), F.col("pred")
    n = F.count_if
    out = [F.count(F.lit(1)).alias("n"), share(n(g == p), F.count(F.lit(1))).alias("accuracy")]
    for label, name in (("not_found", "fabrication"), ("metadata_mismatch", "metadata_error")):
        tp = n((g == label) & (p == label))
        out += [share(tp, n(p == label)).alias(f"{name}_precision"), share(tp, n(g == label)).alias(f"{name}_recall")]
    return x.agg(*out, share(n((g == "verified") & (p == "not_found")), n(g == "verified")).alias("false_accusation_rate"))


def abstention(x: DataFrame, facets: list[str]) -> DataFrame:
    """Abstentions that were right and wrong, by facet and value."""
    rows = x.where(F.col("pred") == "insufficient_evidence").select("gold", F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.nullif(f, F.lit("")), F.lit("unknown")).alias("value")) for f in facets))).alias("k"))
    right = F.col("gold") == "insufficient_evidence"
    return rows.groupBy("k.facet", "k.value").agg(F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """Cases of a review queue by severity, with the first ten."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("severity").orderBy(F.desc("first"), "case_type", "case_id")
    few = queue.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("severity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "case_id"))), lambda s: s["case_id"].cast("string")), ",").alias("first_ten"))
    return queue.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("n_test")).join(few, "severity")


def config_ranking(configs: DataFrame, k: int) -> DataFrame:
    """The k best configurations: F1, precision, false-support rate, accuracy and recall decide, then the parameters."""
    one = F.lit(1)
    fsr = F.round(F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one), 4)
    acc = F.round((F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), one), 4)
    x = configs.withColumns({"false_support_rate": fsr, "accuracy": acc})
    return x.orderBy(F.desc("f1"), F.desc("prec"), "false_support_rate", F.desc("accuracy"), F.desc("recall"), "w", "threshold", "floor").limit(k)


def release_status(maturity_ok: Column, blocked: Column, review: Column) -> Column:
    return F.when(blocked, "blocked").when(~maturity_ok, "immature").when(review, "review_required").otherwise("clear")


def review_coverage(x: DataFrame, reviewed: Column) -> DataFrame:
    """Reviewed cases by language and case type, with all subtotals (null is all)."""
    return x.withColumn("__r", reviewed).cube("lang", "case_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("__r").alias("n_reviewed")).withColumn("coverage", share(F.col("n_reviewed"), F.col("n")))
