"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ["bm25_topk", "cosine_topk", "hybrid_topk", "normalize_text", "tf_norms", "fallback_cascade", "verify_citations", "risk_ranking", "merge_records", "evidence_spans", "support_set", "grouped_metrics", "calibration_grid", "cache_upsert_latest", "stream_sessions"]


def main() -> None:
    from quillmark.plans.catalogue import queries
    from quillmark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known, took = queries(), {}
    known["normalize_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up: the JVM and the page cache
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query is timed on what another has cached
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
