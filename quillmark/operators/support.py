"""Evidence spans, support scores, contradiction rules, decisions and their aggregation over citation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import bigrams, collapse, normalize_text, overlap, sentence_parts, tokenize, with_whole
from quillmark.operators import rules

#: Cue words of contradiction, weights of verifiers, priorities of scopes.
CUES = "but cannot fail failed fails however inconsistent limited low negative no not unclear weak".split()
WEIGHTS = {"existence": 0.35, "metadata": 0.25, "support": 0.30, "contradiction": 0.10}
PRIORITY = {"full_text": 5, "abstract": 4, "metadata_snippet": 3, "metadata": 2, "title": 1}


def evidence_spans(records: DataFrame, key: str) -> DataFrame:
    """(key, ord, scope, text): the title, then the sentences of the abstract; a text that repeats counts once, at its first place."""
    # columns of their own, as an expression inside an array function is computed again wherever it stands
    x = records.select(key, collapse("title").alias("__t"), collapse("abstract").alias("__w")).withColumn("__p", sentence_parts("__w"))
    title = F.filter(F.array("__t"), lambda t: F.length(t) > 0)
    x = x.select(key, F.size(title).alias("__n"), F.concat(title, with_whole(F.col("__p"), F.col("__w"))).alias("__l"))
    # the places of each text stand together, so a document's repeats are found within its row: no text is shuffled
    x = x.select(key, "__n", F.array_sort(F.transform("__l", lambda t, i: F.struct(t.alias("text"), i.alias("ord")))).alias("__s"))
    first = F.filter("__s", lambda s, i: (i == 0) | (s["text"] != F.get("__s", i - 1)["text"]))
    x = x.select(key, "__n", F.explode(first).alias("s"))
    return x.select(key, "s.ord", F.when(F.col("s.ord") < F.col("__n"), "title").otherwise("abstract").alias("scope"), "s.text")


def heuristic_support(pairs: DataFrame, claim: str, evidence: str, threshold: float = 0.18) -> DataFrame:
    """Adds shared, coverage, prec, phrase, score and passed. Each text is tokenized once: the token arrays are columns of their own."""
    x = pairs.withColumns({"__c": tokenize(claim), "__e": tokenize(evidence)})
    x = x.withColumns({"__a": F.array_distinct("__c"), "__b": F.array_distinct("__e"), "__ab": bigrams("__c"), "__bb": bigrams("__e")})
    x = x.withColumns({"shared": overlap(F.col("__a"), F.col("__b")), "__p": overlap(F.col("__ab"), F.col("__bb")), "__na": F.size("__a"), "__nb": F.size("__b"), "__nab": F.size("__ab")})
    one = F.lit(1)
    x = x.withColumns({"coverage": F.col("shared") / F.greatest("__na", one), "prec": F.col("shared") / F.greatest("__nb", one), "phrase": F.when(F.col("__nab") == 0, F.lit(0.0)).otherwise(F.col("__p") / F.greatest("__nab", one))})
    x = x.withColumn("score", F.least(F.lit(1.0), 0.55 * F.col("coverage") + 0.25 * F.col("prec") + 0.20 * F.col("phrase")))
    x = x.withColumn("passed", (F.col("score") >= threshold) & (F.col("shared") >= 2))
    return x.drop("__c", "__e", "__a", "__b", "__ab", "__bb", "__p", "__na", "__nb", "__nab")


def related(shared: Column, coverage: Column, precision: Column) -> Column:
    return ((shared >= 2) & (coverage >= 0.25)) | ((shared >= 3) & (precision >= 0.15))


def contradiction(claim: Column, evidence: Column) -> Column:
    """Whether a rule of contradiction fires, in either language."""
    return rules.family("contradiction", normalize_text(claim), normalize_text(evidence))


def full_text_boundary(claim: Column, evidence: Column) -> Column:
    """Whether the evidence defers what the claim needs, or is synthetic where it claims review."""
    return rules.family("boundary", normalize_text(claim), normalize_text(evidence))


def best_span(scored: DataFrame, claim: str, score: str = "score") -> DataFrame:
    """First maximum by score, scope priority and place."""
    prio = F.coalesce(F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))[F.col("scope")], F.lit(0))
    return scored.groupBy(claim).agg(F.max_by(F.struct("citation", "ord", "scope", score), F.struct(F.col(score), prio, -F.col("citation"), -F.col("ord"))).alias("b")).select(claim, "b.*")


def decide(entail: Column, contra: Column, explicit: Column, anchor: Column, boundary: Column, scope: Column) -> Column:
    """Decision list over scores in [0, 1]: explicit contradiction, boundary, entailment, contradiction, weak support, nothing."""
    direct = scope.isin("metadata_snippet", "full_text") & (entail >= 0.40) & (entail >= contra + 0.05) & (anchor >= 0.18)
    return (
        F.when(explicit >= 0.55, "contradicted")
        .when(boundary & (scope != "full_text"), "insufficient_evidence")
        .when((entail >= 0.55) & (entail >= contra + 0.05), "supported")
        .when((contra >= 0.55) & (anchor >= 0.30), "contradicted")
        .when(direct, "supported")
        .when((anchor > 0) & (entail >= 0.30) & (entail >= contra + 0.05), "weakly_supported")
        .otherwise("insufficient_evidence")
    )


def support_set(members: DataFrame, key: str) -> DataFrame:
    """Verdict over the citations of a claim: contradicted > supported > weakly_supported > insufficient_evidence."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    top = lambda v: F.max(F.when(F.col("verdict") == v, F.col("confidence")))
    x = members.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), n("contradicted").alias("n_contradicted"), n("supported").alias("n_supported"), n("weakly_supported").alias("n_weak"),
        top("contradicted").alias("__c"), top("supported").alias("__s"), F.avg(F.when(F.col("verdict") == "weakly_supported", F.col("confidence"))).alias("__w"),
    )
    verdict = F.when(F.col("n_contradicted") > 0, "contradicted").when(F.col("n_supported") > 0, "supported").when(F.col("n_weak") > 0, "weakly_supported").otherwise("insufficient_evidence")
    conf = F.when(F.col("n_contradicted") > 0, F.col("__c")).when(F.col("n_supported") > 0, F.col("__s")).when(F.col("n_weak") > 0, F.col("__w")).otherwise(0.0)
    return x.select(key, verdict.alias("verdict"), F.round(conf, 4).alias("confidence"), "n", "n_contradicted", "n_supported", "n_weak")


def contradiction_risk(pairs: DataFrame, claim: str, evidence: str) -> DataFrame:
    """Adds risk: cue words of the evidence against what it shares with the claim."""
    x = pairs.withColumns({"__c": F.array_distinct(tokenize(claim)), "__e": F.array_distinct(tokenize(evidence))})
    x = x.withColumns({"__s": overlap(F.col("__c"), F.col("__e")), "__h": overlap(F.col("__e"), F.array(*map(F.lit, CUES)))})
    by_overlap = F.when(F.col("__s") > 0, F.least(F.lit(1.0), F.col("__h") / F.greatest("__s", F.lit(1)))).otherwise(0.0)
    return x.withColumn("risk", F.greatest(by_overlap, F.least(F.lit(1.0), F.col("__h") / 3.0))).drop("__c", "__e", "__s", "__h")


def fuse(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted quality over the verifiers that are there, risk, and the gate's action."""
    w = F.coalesce(F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[F.col("verifier")], F.lit(0.0))
    x = findings.groupBy(*keys).agg(F.sum(F.col("score") * w).alias("s"), F.sum(w).alias("w"), F.max(F.when(~F.col("passed") & F.col("verifier").isin("existence", "metadata"), 1).otherwise(0)).alias("invalid"), F.max(F.when(~F.col("passed") & (F.col("verifier") == "support"), 1).otherwise(0)).alias("unsupported"))
    risk = F.round(1 - F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0), 6)
    x = x.withColumn("risk", risk)
    action = F.when(F.col("invalid") == 1, "abstain").when((F.col("risk") <= 0.35) & (F.col("unsupported") == 0), "cite").when(F.col("risk") <= 0.55, "rewrite").otherwise("abstain")
    return x.select(*keys, "risk", action.alias("action"))


def best_decision(gated: DataFrame, claim: str, citation: str) -> DataFrame:
    rank = F.when(F.col("action") == "cite", 2).when(F.col("action") == "rewrite", 1).otherwise(0)
    return gated.groupBy(claim).agg(F.max_by(F.struct(citation, "action", "risk"), F.struct(rank, -F.col("risk"), -F.col(citation))).alias("b")).select(claim, "b.*")
