"""Connected components by repeated contraction.

Each round sends every node to its least neighbour (or itself), in an order that a hash of the node
draws anew each round, and maps the links through that. Rounds shrink the links by a constant factor
in expectation, also on long chains. Nothing but the number of links left reaches the driver; every
round's tables are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.scratch import Scratch


def connected_components(work: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (two columns of one type) to (node, root): one row per node that has a link, ``root`` some node of its component."""
    cur = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    cur = work.write(cur.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    seed = 0
    while not cur.isEmpty():
        seed += 1
        rank = lambda c, s=seed: F.struct(F.xxhash64(c, F.lit(s)).alias("h"), F.col(c).alias("v"))
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = work.write(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = cur.join(left, "a").join(right, "b").where(F.col("ta") != F.col("tb"))
        nxt = work.write(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        work.drop(cur)
        cur = nxt
    if not steps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("root").alias("r"))
        out = step.join(later, "to", "left").select("node", F.coalesce("r", "to").alias("root"))
    out = work.write(out, "components")
    work.drop(cur, *steps)
    return out
