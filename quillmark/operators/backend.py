"""Models that score pairs of claim and evidence, as batches on the executors.

A backend is a function without arguments that loads a model and returns ``predict(claims, texts)``: arrays of strings to a dict of
arrays, entail and contra (in [0, 1]) and perhaps rerank. It runs once for each worker, not for each batch. A backend that raises ``Unavailable`` when it
loads, or is not given, leaves nulls, which ``assess`` takes as words alone; any other error ends the query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BATCH = 256
SCORES = ("entail", "contra", "rerank")
_RESULT = StructType([StructField(s, DoubleType()) for s in SCORES])


class Unavailable(Exception):
    """The model, or what it needs, is not there."""


Backend = Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]]


def _loaded(backend: Backend):
    def make():
        try:
            predict = backend()
        except Unavailable:
            predict = None

        def run(claims: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
            nothing = np.full(len(claims), np.nan)
            got = {} if predict is None else predict(claims, texts)
            return {s: np.asarray(got.get(s, nothing), dtype="float64") for s in SCORES}

        return run

    return make


def scored(pairs: DataFrame, backend: Backend | None, claim: str = "claim", text: str = "text", batch: int = BATCH) -> DataFrame:
    """Adds entail, contra and rerank; null where the backend has none. Null texts are scored as empty ones."""
    if backend is None:
        return pairs.withColumns({s: F.lit(None).cast("double") for s in SCORES})
    udf = predict_batch_udf(_loaded(backend), return_type=_RESULT, batch_size=batch)
    said = [F.coalesce(F.col(c), F.lit("")) for c in (claim, text)]
    x = pairs.withColumn("__m", udf(*said))
    return x.withColumns({s: F.when(~F.isnan(f"__m.{s}"), F.col(f"__m.{s}")) for s in SCORES}).drop("__m")
