"""Registered queries of the numbered operators, and their DuckDB oracles."""

from __future__ import annotations

from . import (
    centroids,
    decontaminate,
    html,
    language,
    licenses,
    linededup,
    manifest,
    mixing,
    neardup_vectors,
    pieces,
    secrets,
    similarity,
    toxicity,
)

QUERIES = {
    "op1_ngram_join": similarity.query,
    "op2_toxicity": toxicity.query,
    "op3_sentencepiece": pieces.query,
    "op4_html_extraction": html.query,
    "op5_secret_scan": secrets.query,
    "op6_vector_near_dedup": neardup_vectors.query,
    "op7_language_id": language.query,
    "op8_line_dedup": linededup.query,
    "op9_license_scan": licenses.query,
    "op10_decontamination": decontaminate.query,
    "op11_merkle_manifest": manifest.query,
    "op12_centroid_clustering": centroids.query,
    "op13_source_mixing": mixing.query,
}

ORACLES = {
    "op6_vector_near_dedup": neardup_vectors.ORACLE_SQL,
    "op8_line_dedup": linededup.ORACLE_SQL,
    "op1_ngram_join": similarity.ORACLE_SQL,
    "op9_license_scan": licenses.ORACLE_SQL,
    "op10_decontamination": decontaminate.ORACLE_SQL,
    "op11_merkle_manifest": manifest.ORACLE_SQL,
    "op12_centroid_clustering": centroids.ORACLE_SQL,
}
