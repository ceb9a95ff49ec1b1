"""Label provenance: sidecar joins, merged annotations, adjudication, maturity, coverage, validation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.session import written

#: States of a label's provenance.
STATUS = ("not_human_reviewed", "single_annotator", "dual_annotator_agreed", "dual_annotator_adjudicated", "published")


def with_sidecar(cases: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Each case with its provenance; without one it counts as not reviewed."""
    return cases.join(sidecar, "case_id", "left").withColumn("status", F.coalesce("status", F.lit(STATUS[0]))).withColumn("annotators", F.coalesce("annotators", F.lit(0)))


def orphans(sidecar: DataFrame, cases: DataFrame) -> DataFrame:
    return sidecar.join(cases.select("case_id"), "case_id", "left_anti").select("case_id")


def merged(annotations: DataFrame) -> DataFrame:
    """One row per case from (case_id, annotator, label): labels, whether they agree, and the status that follows."""
    x = annotations.groupBy("case_id").agg(F.count(F.lit(1)).alias("annotators"), F.countDistinct("label").alias("kinds"), F.min("label").alias("first"), F.max("label").alias("last"))
    status = F.when(F.col("annotators") == 1, STATUS[1]).when(F.col("kinds") == 1, STATUS[2]).otherwise("conflict")
    return x.select("case_id", "annotators", status.alias("status"), F.when(F.col("kinds") == 1, F.col("first")).alias("label"), F.concat_ws("/", "first", "last").alias("seen"))


def adjudicated(merged_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts take the label of their decision, which must be the gold label; others stay a conflict."""
    x = merged_.join(decisions.select("case_id", F.col("label").alias("decided"), "gold"), "case_id", "left")
    settled = (F.col("status") == "conflict") & (F.col("decided") == F.col("gold"))
    return x.select("case_id", "annotators", F.when(settled, STATUS[3]).otherwise(F.col("status")).alias("status"), F.when(settled, F.col("decided")).otherwise(F.col("label")).alias("label"))


def maturity(labelled: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    total = F.count(F.lit(1))
    dual = n(*STATUS[2:4])
    rate = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1))), 4)
    return labelled.agg(total.alias("n"), n(STATUS[0]).alias("unreviewed"), n(STATUS[1]).alias("single"), dual.alias("dual"), rate(total - n(STATUS[0]), total).alias("reviewed_rate"), rate(n(STATUS[2]), dual).alias("agreement_rate"))


def coverage(labelled: DataFrame) -> DataFrame:
    """Reviewed share by language and type of case."""
    hit = F.count_if(F.col("status") != STATUS[0])
    return labelled.groupBy("lang", "case_type").agg(F.count(F.lit(1)).alias("n"), hit.alias("reviewed"), F.round(hit / F.count(F.lit(1)), 4).alias("rate"))


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """One row: the thresholds that a row of metrics misses, and whether it passes."""
    missed = F.filter(F.array(*(F.when(F.col(k) < v, k) for k, v in least.items())), lambda x: x.isNotNull())
    return metrics.select(F.array_join(missed, ",").alias("failed"), (F.size(missed) == 0).alias("passed"))


def validation(cases: DataFrame, key: str, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """(problem, value): required values that no case has, and keys that repeat."""
    out = cases.groupBy(key).count().where("count > 1").select(F.lit(f"duplicate_{key}").alias("problem"), F.col(key).cast("string").alias("value"))
    for column, values in required.items():
        wanted = cases.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
        out = out.unionByName(wanted.join(cases.select(column).distinct(), column, "left_anti").select(F.lit(f"missing_{column}").alias("problem"), F.col(column).alias("value")))
    return out


def _last(rows: DataFrame, facet: str, cap: int) -> DataFrame:
    """(value, last): where the cap-th of the rows with a value of the facet stands, for values that have so many."""
    w = Window.partitionBy(facet).orderBy("__pos")
    at = rows.select(facet, "__pos").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap)
    return at.groupBy(F.col(facet).alias("value")).agg(F.max("__pos").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") == cap).drop("n")


def _before_all(rows: DataFrame, of: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Adds ``__fits``: whether a row stands before, or at, the end of each of its facets' values among the rows ``of``."""
    fits = F.lit(True)
    for i, (facet, cap) in enumerate(caps.items()):
        rows = rows.join(_last(of, facet, cap).withColumnsRenamed({"value": f"__v{i}", "last": f"__l{i}"}), F.col(facet).eqNullSafe(F.col(f"__v{i}")) & F.col(f"__l{i}").isNotNull(), "left")
        fits = fits & (F.col(f"__l{i}").isNull() | (F.col("__pos") <= F.col(f"__l{i}")))
    return rows.withColumn("__fits", fits).drop(*(f"__{x}{i}" for i in range(len(caps)) for x in "vl"))


def joint_caps(cases: DataFrame, order: list[str], caps: dict[str, int], limit: int) -> DataFrame:
    """Greedy choice in order: a case is taken while none of its facets' values has as many taken as its cap allows; ``limit`` in all.

    ``order`` is total. Rounds close in on the choice from both sides: a case is sure where even all that may be taken leave it room, and
    goes where those that are sure leave it none. The first open case is settled in every round, and as a rule nearly all are in a
    few. A value's end is the place of its cap-th row, so tasks send no more than cap rows of a value, however many it has.
    """
    if limit <= 0 or min(caps.values(), default=1) <= 0:
        return cases.limit(0)
    x = cases.withColumn("__pos", F.struct(*order))
    while True:
        x = _before_all(x, x, caps).withColumnRenamed("__fits", "__sure")
        x = written(x, "caps")
        if x.where(~F.col("__sure")).isEmpty():
            break
        x = _before_all(x.drop("__sure"), x.where("__sure"), caps).where("__fits").drop("__fits")
        x = written(x, "caps")
    return x.orderBy("__pos").limit(limit).select(*cases.columns)


def source_health(calls: DataFrame) -> DataFrame:
    """Per source: calls, failures by kind, and the status that follows."""
    bad = F.count_if(F.col("status_code") >= 400)
    limited = F.count_if(F.col("status_code") == 429)
    x = calls.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), bad.alias("failures"), limited.alias("rate_limited"), F.max("retry_after").alias("retry_after"))
    status: Column = F.when(F.col("failures") == 0, "available").when(F.col("failures") == F.col("calls"), "unavailable").when(F.col("rate_limited") * 2 > F.col("failures"), "rate_limited").otherwise("degraded")
    return x.withColumn("status", status)
