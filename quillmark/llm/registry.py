"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import ann, arrowfile, chat, langid, lattice, lexical, minhash, mixing, packing, periodic, pii, toxicity, warc

#: Query name -> module that has ``query(spark, sf_dir)`` and perhaps ``ORACLE_SQL``.
MODULES = {
    "op1_language_id": langid,
    "op2_warc_index": warc,
    "op3_pii_patterns": pii,
    "op4_pfair_mix": mixing,
    "op5_lattice_neardup": lattice,
    "op6_chat_prefix_targets": chat,
    "op7_toxicity_fm": toxicity,
    "op8_minhash_neardup": minhash,
    "op9_posting_ann": ann,
    "op10_pack_tokens": packing,
    "op11_periodic_runs": periodic,
    "op12_ranked_lexical": lexical,
    "op13_arrow_sequences": arrowfile,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if hasattr(module, "ORACLE_SQL")}
