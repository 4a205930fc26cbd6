"""Queries op1 to op13, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import audit, digests, html_main, neighbours, packing, pieces, pii, quality, secrets, simhash, substrings, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secrets.query,
        "op2_packing": packing.query,
        "op3_pii": pii.query,
        "op4_embedding_near_dedup": neighbours.query,
        "op5_quality_rules": quality.query,
        "op6_suffix_array_dedup": substrings.query,
        "op7_sentencepiece": pieces.query,
        "op8_html_extraction": html_main.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_toxicity": toxicity.query,
        "op11_embedding_whitening": whitening.query,
        "op12_filter_interaction_audit": audit.query,
        "op13_document_fingerprints": digests.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_interaction_audit": audit.SQL}
