"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import changepoints, embeddings, licenses, lm, mixing, negatives, neighbours, packing, pii, quality, secrets, simhash, substring

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_secret_linking": secrets.query,
    "op3_quality_votes": quality.query,
    "op4_pii_boosting": pii.query,
    "op5_substring_anchors": substring.query,
    "op6_source_mix": mixing.query,
    "op7_embedding_pq": embeddings.query,
    "op8_simhash_pigeonhole": simhash.query,
    "op9_gated_lm": lm.query,
    "op10_best_fit_packing": packing.query,
    "op11_projected_neighbours": neighbours.query,
    "op12_hard_negatives": negatives.query,
    "op13_change_points": changepoints.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_linking": secrets.SQL,
    "op5_substring_anchors": substring.SQL,
    "op7_embedding_pq": embeddings.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_change_points": changepoints.SQL,
}
