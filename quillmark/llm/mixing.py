"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents are cut into blocks of BLOCK_CHARS characters. With weight w, block i of a source is released at
slot floor(i / w) and due at ceil((i + 1) / w); of the released blocks the one that is due earliest takes each slot.
Weights are whole parts of HYPER slots, so the schedule repeats every HYPER slots: it is computed for one period
(HYPER rows, whatever the data) and block i of a source with q slots a period stands in period i div q, at that
source's slot number i mod q. A document stands whole in the block where it begins. While a source lasts, the blocks it
has begun in any prefix are less than one from its weight, so its characters are less than one block and its longest document.
Every document appears once: when a source is used up its slots stay empty, and the others go on in proportion.

Places inside a source are prefix sums over parts of about PART_ROWS rows, and so are the places in the whole
sequence, so one source with a third of all rows is many tasks. Inside a source, documents are ordered by a hash of id
and text, then by a hash of all columns: the order does not depend on how the rows are dealt over partitions, and rows
that tie in both are equal. More than MAX_SOURCES sources are an error: group small ones first.

A null source is a source of its own. Null and empty texts count one character, so that they have a place. The weights
default to the sources' sizes to the power ALPHA; sources without a given weight share what is left in proportion to their
sizes (at least one slot each). Repeated rows are rows of their own. Empty tables give no rows; extra columns are kept.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.scratch import Scratch

BLOCK_CHARS = 65_536
HYPER = 4_096
ALPHA = 0.7
PART_ROWS = 4_000
#: The sources' totals, and a timetable of at least two slots for each, are on the driver and broadcast.
MAX_SOURCES = 100_000
#: Slots whose documents are numbered together.
SLOTS = 16


def quotas(sizes: dict, weights: dict | None, hyper: int = HYPER) -> dict:
    """Whole slots per period for each source, by largest remainders; at least one each."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    hyper = max(hyper, 2 * len(names))
    given = {s: max(0.0, float(w)) for s, w in (weights or {}).items() if s in sizes}
    rest = [s for s in names if s not in given]
    free = max(0.0, 1.0 - sum(given.values())) if given else 1.0
    soft = {s: max(1.0, float(sizes[s])) ** ALPHA for s in rest}
    share = given | {s: (free or 1e-9) * soft[s] / sum(soft.values()) for s in rest}
    total = sum(share.values()) or 1.0
    exact = {s: share[s] / total * (hyper - len(names)) for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], names.index(s)))[: hyper - sum(out.values())]:
        out[s] += 1
    return out


def timetable(quota: dict) -> list[tuple]:
    """(source, k, slot) of one period: earliest deadline first among the released blocks, ties in the order of sources."""
    hyper = sum(quota.values())
    names = list(quota)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, k
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(hyper):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * hyper // quota[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        out.append((names[i], k, slot))
        if k + 1 < quota[names[i]]:
            heapq.heappush(waiting, ((k + 1) * hyper // quota[names[i]], i, k + 1))
    return out


def _prefix(work: Scratch, rows: DataFrame, key: list[str], part: str, order: list, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows before, within ``key``, parts in their order and rows by ``order``."""
    before = Window.partitionBy(*key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, part).agg(F.sum(size).alias("__sum"))
    above = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = work.write(sums.withColumn("__above", F.coalesce(F.sum("__sum").over(above), F.lit(0))).drop("__sum"), "sums")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, part]]
    joined = rows.alias("a").join(sums.alias("b"), same).select("a.*", "b.__above")
    return joined.withColumn(out, F.col("__above") + F.coalesce(F.sum(size).over(before), F.lit(0))).drop("__above")


def _key(docs: DataFrame) -> list:
    """The columns that a place is made of."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    doc_id = F.col("doc_id").cast("long")
    return [
        doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.greatest(F.char_length(text), F.lit(1)).cast("long").alias("chars"),
        F.xxhash64(doc_id, text).alias("h"), F.xxhash64(*hashed).alias("tie"),
    ]


def schedule(spark: SparkSession, docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, hyper: int = HYPER) -> DataFrame:
    """row, doc_id, source, chars, block (of its source), slot, position (from 0, gapless) for every row of ``docs``."""
    work = Scratch(spark, "mix")
    rows = work.write(docs.select(F.monotonically_increasing_id().alias("row"), *_key(docs)), "rows")
    return _placed(spark, work, rows, weights, block_chars, hyper)


def _placed(spark: SparkSession, work: Scratch, rows: DataFrame, weights: dict | None, block_chars: int, hyper: int) -> DataFrame:
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not totals:
        return rows.select("row", "doc_id", "source", "chars", *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")))
    quota = quotas({r["source"]: r["chars"] for r in totals}, weights, hyper)
    period = sum(quota.values())
    table = json.dumps([{"s": s, "k": k, "slot": slot} for s, k, slot in timetable(quota)])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<s:string,k:long,slot:long>>")))
    parts = json.dumps([{"s": r["source"], "q": quota[r["source"]], "m": max(1, -(-r["n"] // PART_ROWS))} for r in totals])
    sources = spark.range(1).select(F.inline(F.from_json(F.lit(parts), "array<struct<s:string,q:long,m:long>>")))
    x = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", F.pmod("h", "m"))
    x = _prefix(work, x, ["source"], "part", ["h", "doc_id", "tie", "row"], "chars", "before")
    x = x.withColumn("block", F.expr(f"before div {block_chars}"))
    k = F.col("block") % F.col("q")
    x = x.withColumn("k", k).join(F.broadcast(plan.withColumnRenamed("slot", "at").withColumnRenamed("k", "pk")), F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("pk")))
    x = x.withColumn("slot", F.expr("block div q") * period + F.col("at")).select("row", "doc_id", "source", "chars", "block", "slot", "before", F.expr(f"(block div q * {period} + at) div {SLOTS}").alias("group"), F.lit(1).cast("long").alias("one"))
    x = work.write(x, "slots")
    # the slots are numbered in groups; a first level over groups of groups keeps the prefix sum of groups spread too
    x = x.withColumn("far", F.expr("group div 4096"))
    far = x.groupBy("far").agg(F.count(F.lit(1)).alias("n"))
    far = work.write(far.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("far", "base"), "far")
    y = _prefix(work, x, ["far"], "group", ["slot", "before", "row"], "one", "near")
    return y.join(far, "far").select("row", "doc_id", "source", "chars", "block", "slot", (F.col("base") + F.col("near")).alias("position"))


def mix(spark: SparkSession, docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, partitions: int | None = None, row: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, sorted by their place in the mixture: partitions are consecutive ranges of it.

    ``row``: a column of ``docs`` that numbers its rows, alike whenever they are read, and is left out of the result. Without one the rows are
    written once with numbers.
    """
    names = [c for c in docs.columns if c != row]
    whole = docs.withColumnRenamed(row, "__row") if row else Scratch(spark, "mix").write(docs.select(F.monotonically_increasing_id().alias("__row"), "*"), "docs")
    rows = Scratch(spark, "mix").write(whole.select(F.col("__row").alias("row"), *_key(docs.select(*(F.col(f"`{c}`") for c in names)))), "rows")
    place = _placed(spark, Scratch(spark, "mix"), rows, weights, block_chars, HYPER).select(F.col("row").alias("__row"), F.col("position").alias("__position"))
    joined = whole.join(place, "__row")
    n = [partitions] if partitions else []
    return joined.repartitionByRange(*n, "__position").sortWithinPartitions("__position").select(*(F.col(f"`{c}`") for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "chars", "block", "slot", "position")
