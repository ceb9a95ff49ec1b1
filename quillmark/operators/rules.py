"""Lexical safety rules on pairs of claim and evidence, as a table.

A rule is a cue on the normalised claim and one on the normalised evidence; it fires where both hold. Cues are built from
patterns, term lists and their combinations, and become a Column or the SQL of the same condition, so a rule is written
once. ``evaluate`` normalises each text once and gives one boolean per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import blank, normalize_text


@dataclass(frozen=True)
class Cue:
    """``kind``: re (a pattern), any (one of the terms), all, or, not (of other cues)."""

    kind: str
    parts: tuple

    def column(self, text: Column) -> Column:
        if self.kind == "re":
            return text.rlike(self.parts[0])
        each = [F.contains(text, F.lit(p)) if self.kind == "any" else p.column(text) for p in self.parts]
        out = each[0]
        for e in each[1:]:
            out = out & e if self.kind == "all" else out | e
        return ~out if self.kind == "not" else out

    def sql(self, text: str) -> str:
        if self.kind == "re":
            return f"regexp_matches({text}, '{self.parts[0]}')"
        each = [f"contains({text}, '{p}')" if self.kind == "any" else p.sql(text) for p in self.parts]
        out = "(" + (" AND " if self.kind == "all" else " OR ").join(each) + ")"
        return f"(NOT {out})" if self.kind == "not" else out


def re_(pattern: str) -> Cue:
    return Cue("re", (pattern,))


def any_(*terms: str) -> Cue:
    return Cue("any", terms)


def all_(*cues: Cue) -> Cue:
    return Cue("all", cues)


def or_(*cues: Cue) -> Cue:
    return Cue("or", cues)


def not_(cue: Cue) -> Cue:
    return Cue("not", (cue,))


# Patterns on normalised English text.
IMPROVES = r"\b(improves?|improved|increase[sd]?|increasing|boosts?|boosted|raises?|raised|gains?)\b"
NOT_IMPROVED = (
    r"\b(?:does|do|did)\s+not\s+(?:improve|increase|boost|raise|gain)\b"
    r"|\bnot\s+(?:improve|increase|boost|raise|gain)\b"
    r"|\b(reduces?|reduced|decreases?|decreased|lowers?|lowered|worse|harms?|harmed)\b"
)
NECESSARY = r"\b(always|must|required|requires|necessary|only|all|every)\b"
OPTIONAL = r"\b(optional|not\s+required|not\s+necessary|need\s+not|does\s+not\s+require|do\s+not\s+require|by\s+default)\b"
SUPPORTS = r"\b(supports?|supported|proves?|proved|demonstrates?|shows?)\b"
NO_SUPPORT_CLAIM = r"\b(?:not|fail(?:s|ed|ing)?|without|cannot|does\s+not|do\s+not|did\s+not)\s+(?:to\s+)?support\b"
SUPPORT_DENIED = r"\b(?:does|do|did)\s+not\s+support\b|\bnot\s+support\b|\bfails?\s+to\s+support\b"
VERDICT = r"\b(?:is|are)\b.*\b(?:final|definitive)\b.*\b(?:verdicts?|decisions?|proof)\b"
VERDICT_DENIED = r"\b(?:must|should|can)\s+not\b.*\b(?:presented|treated|classified|used)\b.*\b(?:verdicts?|decisions?|proof)\b"
FABRICATED = r"\b(?:treats?|marks?|labels?|flags?|classifies?)\b.*\bfabricated\b"
FABRICATED_DENIED = (
    r"\b(?:does|do|did)\s+not\s+(?:treat|mark|label|flag|classify)\b.*\bfabricated\b"
    r"|\bnot\s+(?:treat|mark|label|flag|classify)(?:ed)?\b.*\bfabricated\b"
)
DETAILED = r"\b(?:excluded?|exclusion|eligibility|all|every|complete|full|supplement(?:ary)?|appendix|methods?)\b"
DEFERRED = (
    r"\b(?:does|do|did)\s+not\s+(?:describe|report|include|state)\b"
    r"|\b(?:not|never)\s+(?:described|reported|included|stated)\b"
    r"|\b(?:see|refer(?:s|red)?\s+to|available\s+in)\b.*\b(?:supplement(?:ary)?|appendix|full[-\s]?text|methods?)\b"
)
HUMAN_REVIEWED = (
    r"\b(?:independent(?:ly)?|human[-\s]?reviewed|human[-\s]?annotated|adjudicated)\b.*\bbenchmark\b"
    r"|\bbenchmark\b.*\b(?:independent(?:ly)?|human[-\s]?reviewed|human[-\s]?annotated|adjudicated)\b"
)
SYNTHETIC = r"\b(?:maintainer[-\s]?authored|synthetic|not\s+human[-\s]?reviewed|independent\s+(?:annotation|review|adjudication).{0,30}\bplanned)\b"
OUTAGE = r"\b(?:source|sources|outage|outages|unavailable|timeout|timeouts|not_found|not\s+found|missing)\b"
FAKE = r"\b(?:fabricated|fake|false|hallucinated|forged)\b"
CONFIDENCE = r"\b(?:increase|raises?|boosts?|proves?|evidence|confidence)\b"
INFERS = r"\b(?:proves?|means?|demonstrates?|indicates?|treats?|labels?|classifies?|marks?|increases?|raises?|boosts?)\b"
SAFE = (
    r"\b(?:lower|lowers|reduced?|decrease[sd]?|inconclusive|retry|source[-\s]?health)\b.*\b(?:confidence|certainty|inspection|check)\b"
    r"|\bnot\s+(?:evidence|proof)\b.*\b(?:fabricated|fake|false|hallucinated|forged)\b"
    r"|\bmust\s+not\b.*\b(?:fabricated|fake|false|hallucinated|forged)\b"
)
# Terms and patterns on Chinese text.
ZH_OUTAGE = ("源不可达", "来源不可达", "数据源不可达", "源失败", "来源失败", "源故障", "来源故障", "检索失败", "查询失败", "超时", "限流", "未找到", "找不到")
ZH_OUTAGE_NEAR = "(?:来源?|数据源).{0,4}(?:不可达|失败|故障)"
ZH_FABRICATION = ("伪造", "虚假", "编造", "幻觉", "捏造")
ZH_CONFIDENCE = ("提高", "增加", "提升", "证明", "证据", "置信", "确信")
ZH_CONFIDENCE_REDUCTION = ("降低", "下调", "减少")
ZH_CERTAINTY = ("置信", "可信", "确定")
ZH_PROOF_DENIAL = ("不能证明", "无法证明", "不可证明")
ZH_EVIDENCE_DENIAL = ("不是证据", "并非证据", "不构成证据", "不能作为证据")
ZH_CLASSIFICATION_DENIAL = ("不应", "不能", "不可")
ZH_CLASSIFICATION = ("指控", "判定", "标记", "归类")
ZH_RETRY_OR_HEALTH = ("来源健康", "源健康", "稍后重试", "人工复核")
ZH_INFERS = ("证明", "意味着", "表明", "判定", "标记", "归类", "就是", "作为", "提高", "增加", "提升")
ZH_DENIES = "(?:不应|不能|不可(?:将|把|视为|判定|标记|归类))"
ZH_UNIVERSAL = ("一定", "总是", "所有", "全部", "必然", "必须")
ZH_NOT_UNIVERSAL = ("未必", "不一定", "并非", "不总是", "不必", "可选")
ZH_IMPROVES = ("提升", "提高", "增加", "改善")
ZH_NOT_IMPROVED = ("降低", "减少", "未提升", "没有提升", "不提升", "下降")
ZH_SUPPORT_DENIED = ("不支持", "未支持", "未必支持", "不能支持")
ZH_DETAILED = ("所有", "全部", "完整", "排除标准", "纳入标准", "补充材料", "附录")
ZH_DEFERRED = ("未描述", "没有描述", "未报告", "没有报告", "详见补充材料", "见补充材料", "摘要仅", "全文详见")
ZH_REVIEWED = ("独立评审", "人工评审", "人工标注", "人工裁决")
ZH_SYNTHETIC = ("维护者合成", "维护者编写", "未人工评审", "尚未人工评审", "计划独立评审")
# What a probe adds to the claim, and the words that call for it.
PROBES = (
    ("improvement_negation", r"\b(improves?|improved|increase[sd]?|boosts?|raises?|gains?)\b", (), "does not improve no improvement decreases worse"),
    ("support_negation", r"\b(supports?|supported|proves?|demonstrates?|shows?)\b", (), "does not support fails to support no evidence"),
    ("necessity_exception", r"\b(always|must|required|requires|necessary|only|all|every)\b", (), "optional not required not necessary exception"),
    (
        "source_outage_safety",
        r"\b(source|sources|outage|outages|unavailable|timeout|timeouts|not_found|not\s+found|fabricated|fake|hallucinated)\b",
        (*ZH_OUTAGE, *ZH_FABRICATION),
        "source outage unavailable timeout not found not evidence fabricated lower confidence inconclusive "
        + " ".join([*ZH_OUTAGE, *ZH_PROOF_DENIAL, *ZH_EVIDENCE_DENIAL, *ZH_CONFIDENCE_REDUCTION, *ZH_CERTAINTY, *ZH_FABRICATION, *ZH_RETRY_OR_HEALTH]),
    ),
    ("zh_improvement_negation", None, ("提升", "提高", "增加", "改善"), "未提升 没有提升 降低 减少"),
    ("zh_necessity_exception", None, ("一定", "总是", "所有", "全部", "必须"), "未必 不一定 并非 可选"),
)

_outage = or_(re_(OUTAGE), any_(*ZH_OUTAGE), re_(ZH_OUTAGE_NEAR))
_zh_denial = or_(any_(*ZH_PROOF_DENIAL, *ZH_EVIDENCE_DENIAL), re_(ZH_DENIES))
_unsafe = or_(re_(INFERS), all_(any_(*ZH_INFERS), not_(_zh_denial)))
_zh_safe = or_(
    all_(any_(*ZH_CONFIDENCE_REDUCTION), any_(*ZH_CERTAINTY)),
    all_(any_(*ZH_PROOF_DENIAL, *ZH_EVIDENCE_DENIAL), any_(*ZH_FABRICATION)),
    all_(any_(*ZH_CLASSIFICATION_DENIAL), any_(*ZH_CLASSIFICATION), any_(*ZH_FABRICATION)),
    any_(*ZH_RETRY_OR_HEALTH),
)


@dataclass(frozen=True)
class Rule:
    """``family``: contradiction, boundary (the evidence defers or is synthetic) or outage (a failed source proves nothing)."""

    name: str
    language: str
    family: str
    claim: Cue
    evidence: Cue


RULES = (
    Rule("en_improvement_denial", "en", "contradiction", re_(IMPROVES), re_(NOT_IMPROVED)),
    Rule("en_necessity_denial", "en", "contradiction", re_(NECESSARY), re_(OPTIONAL)),
    Rule("en_support_denial", "en", "contradiction", all_(re_(SUPPORTS), not_(re_(NO_SUPPORT_CLAIM))), re_(SUPPORT_DENIED)),
    Rule("en_verdict_classification_denial", "en", "contradiction", re_(VERDICT), re_(VERDICT_DENIED)),
    Rule("en_fabrication_denial", "en", "contradiction", re_(FABRICATED), re_(FABRICATED_DENIED)),
    Rule("zh_universal_denial", "zh", "contradiction", any_(*ZH_UNIVERSAL), any_(*ZH_NOT_UNIVERSAL)),
    Rule("zh_improvement_denial", "zh", "contradiction", any_(*ZH_IMPROVES), any_(*ZH_NOT_IMPROVED)),
    Rule("zh_support_denial", "zh", "contradiction", all_(any_("支持"), not_(any_(*ZH_SUPPORT_DENIED))), any_(*ZH_SUPPORT_DENIED)),
    Rule("full_text_boundary_en", "en", "boundary", re_(DETAILED), re_(DEFERRED)),
    Rule("full_text_boundary_zh", "zh", "boundary", any_(*ZH_DETAILED), any_(*ZH_DEFERRED)),
    Rule("human_review_provenance_boundary", "en", "boundary", re_(HUMAN_REVIEWED), re_(SYNTHETIC)),
    Rule("human_review_provenance_boundary_zh", "zh", "boundary", all_(any_("基准"), any_(*ZH_REVIEWED)), any_(*ZH_SYNTHETIC)),
    Rule("source_outage_safety", "both", "outage", all_(_outage, or_(re_(FAKE), any_(*ZH_FABRICATION), re_(CONFIDENCE), any_(*ZH_CONFIDENCE)), _unsafe), all_(_outage, or_(re_(SAFE), _zh_safe))),
)


def family(name: str, claim: Column, evidence: Column) -> Column:
    """Whether a rule of the family fires, on normalised texts."""
    out = F.lit(False)
    for r in RULES:
        if r.family == name:
            out = out | (r.claim.column(claim) & r.evidence.column(evidence))
    return out


def family_sql(name: str, claim: str, evidence: str) -> str:
    return "(" + " OR ".join(f"({r.claim.sql(claim)} AND {r.evidence.sql(evidence)})" for r in RULES if r.family == name) + ")"


def cues(norm: Column, side: str) -> Column:
    """The rules whose claim, or evidence, has its cue in a normalised text, as bits in the order of the table: a rule fires where both sides have its bit."""
    return sum((F.when(getattr(r, side).column(norm), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0)).cast("int")


def bits(name: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.family == name)


def evaluate(pairs: DataFrame, claim: str, evidence: str) -> DataFrame:
    """Adds fired (names of the rules that hold, in the order of the table), contradicts, boundary and outage."""
    x = pairs.withColumns({"__c": normalize_text(claim), "__e": normalize_text(evidence)})
    names = F.array(*(F.when(r.claim.column(F.col("__c")) & r.evidence.column(F.col("__e")), r.name) for r in RULES))
    x = x.withColumn("fired", F.array_compact(names)).drop("__c", "__e")
    of = lambda kind: F.arrays_overlap("fired", F.array(*(F.lit(r.name) for r in RULES if r.family == kind)))
    return x.withColumns({"contradicts": of("contradiction"), "boundary": of("boundary"), "outage": of("outage")})


def probe_cue(pattern: str | None, terms: tuple) -> Cue:
    cues = [*([re_(pattern)] if pattern else []), *([any_(*terms)] if terms else [])]
    return or_(*cues)


def counter_queries(claims: DataFrame, key: str, text: str) -> DataFrame:
    """(key, role, query): the claim, and the probes that its words call for."""
    x = claims.select(key, blank(text).alias("__c"), normalize_text(text).alias("__n"))
    own = F.struct(F.lit("claim_similarity").alias("role"), F.col("__c").alias("query"))
    more = [F.when(probe_cue(p, t).column(F.col("__n")), F.struct(F.lit(role).alias("role"), F.concat("__c", F.lit(" " + tail)).alias("query"))) for role, p, t, tail in PROBES]
    return x.select(key, F.explode(F.array_compact(F.array(own, *more))).alias("x")).select(key, "x.role", "x.query")


def explicit_confidence(shared: Column, coverage: Column, precision: Column, score: Column, contradicts: Column, outage: Column) -> Column:
    """Confidence of a contradiction by cue: 0 without one, or if the texts are not related (a failed source always is)."""
    related = ((shared >= 2) & (coverage >= 0.25)) | ((shared >= 3) & (precision >= 0.15))
    raw = 0.50 + 0.40 * coverage + 0.20 * precision + 0.10 * F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.when((related | outage) & (contradicts | outage), F.round(F.least(F.lit(0.85), F.greatest(F.lit(0.58), raw)), 4)).otherwise(0.0)


def counter_evidence(pairs: DataFrame, claim: str, evidence: str, source_score: Column) -> DataFrame:
    """Adds score and signal of records found for a claim; those that score nothing go."""
    from quillmark.operators.support import heuristic_support

    x = evaluate(heuristic_support(pairs, claim, evidence).drop("score", "passed", "phrase", "prec"), claim, evidence)
    cue = F.when(F.col("contradicts") | F.col("outage"), 1.0).otherwise(0.0)
    x = x.withColumn("score", F.round(F.least(F.lit(1.0), 0.55 * F.col("coverage") + 0.35 * cue + 0.10 * source_score), 4))
    signal = F.when(F.col("outage"), "source_outage_safety_cue").when(F.col("contradicts"), "explicit_contradiction_cue").otherwise("related_candidate")
    return x.where("score > 0").withColumn("signal", signal).drop("fired", "contradicts", "boundary", "outage", "shared", "coverage")
