"""Audits of references as they arrive.

The corpus is looked up through tables made once (``audit.Lookups``). Each trigger's references, without those whose id came before
(the ids are the stream's state), are resolved and compared as in a batch, and written to a folder named by the batch; a batch that is
replayed writes the same folder again. The result over all triggers is that of one batch over all references, whatever files they came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators import audit

FIELDS = ("title", "authors", "year", "venue", "doi", "arxiv_id")
RESULT = "cand_id long, doc_id long, method string, mismatches long, verdict string"


def audit_batch(candidates: DataFrame, corpus: DataFrame, lookups: audit.Lookups | None = None) -> DataFrame:
    """(cand_id, doc_id, method, mismatches, verdict): what a reference names, by ``audit.cascade``, and how many of its fields differ."""
    found = audit.cascade(candidates, lookups or audit.Lookups(corpus))
    pairs = found.where("doc_id is not null").join(candidates.select("cand_id", F.struct(*FIELDS).alias("cand")), "cand_id").join(corpus.select("doc_id", F.struct(*FIELDS).alias("rec")), "doc_id")
    bad = audit.field_diffs(pairs.select("cand_id", "cand", "rec")).groupBy("cand_id").agg(F.count_if(~F.col("matches")).alias("mismatches"))
    x = found.join(bad, "cand_id", "left").withColumn("mismatches", F.coalesce("mismatches", F.lit(0)).cast("long"))
    verdict = F.when(F.col("method") == "none", "not_found").when(F.col("mismatches") > 0, "metadata_mismatch").otherwise("verified")
    return x.select("cand_id", "doc_id", "method", "mismatches", verdict.alias("verdict"))


def audits(stream: DataFrame, corpus: DataFrame, folder: str) -> StreamingQuery:
    """Starts the audit of a stream of references until its input is used up; ``results`` reads what it wrote under ``folder``."""
    lookups = audit.Lookups(corpus, f"{folder}/lookups")

    def one(batch: DataFrame, batch_id: int) -> None:
        audit_batch(batch, corpus, lookups).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return stream.dropDuplicates(["cand_id"]).writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def results(like: DataFrame, folder: str) -> DataFrame:
    return like.sparkSession.read.schema(RESULT).parquet(f"{folder}/out").select(*(x.split()[0] for x in RESULT.split(", ")))
