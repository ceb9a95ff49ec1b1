"""The contract of models: loaded on the workers, in batches, with nulls where there is none."""

import numpy as np
import pytest

from quillmark.operators import assess, backend

SPANS = [(0, 0, 0, "abstract", "Pruning improves speed", "Pruning improves speed a lot"), (1, 0, 0, "abstract", "Pruning improves speed", "Cooking at home"), (2, 0, 0, "title", "Pruning improves speed", None), (3, 0, 0, "abstract", "Pruning improves speed", "Trees grow in spring, against speed")]
SCHEMA = "query_id long, citation long, ord int, scope string, claim string, text string"


def models():
    """Made here, so that workers get them whole: they cannot import this file."""

    def stub():
        """A model that goes by words: what is said again is entailed, ``against`` contradicts."""

        def predict(claims, texts):
            assert len(claims) == len(texts) <= 2
            shared = np.array([len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(a.split())) for a, b in zip(claims, texts, strict=True)])
            return {"entail": np.minimum(0.95, shared), "contra": np.array([0.9 if "against" in t else 0.02 for t in texts])}

        return predict

    def absent():
        raise backend.Unavailable("no model here")

    def broken():
        raise OSError("disk")

    return stub, absent, broken


stub, absent, broken = models()


def _verdicts(spark, model):
    spans = spark.createDataFrame(SPANS, SCHEMA)
    x = assess.scored_spans(backend.scored(spans, model, batch=2).drop("rerank"))
    return {r["query_id"]: (r["verdict"], r["engine"]) for r in assess.assess(x, ["query_id", "citation"]).collect()}


def test_a_stub_model_goes_through_assess(spark):
    got = _verdicts(spark, stub)
    assert got[0] == ("supported", "ensemble") and got[1][0] == "insufficient_evidence" and got[3] == ("contradicted", "ensemble")
    scores = backend.scored(spark.createDataFrame(SPANS, SCHEMA), stub, batch=2).collect()
    assert [r["rerank"] for r in scores] == [None] * 4 and scores[2]["entail"] == 0.0 and scores[3]["contra"] == 0.9


@pytest.mark.parametrize("model", [None, absent])
def test_without_a_model_words_decide(spark, model):
    got = _verdicts(spark, model)
    assert {e for _, e in got.values()} == {"heuristic"} and got[0][0] == "weakly_supported"


def test_errors_are_not_swallowed(spark):
    with pytest.raises(Exception, match="disk"):
        _verdicts(spark, broken)
