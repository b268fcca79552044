"""Queries of the corpus operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import ann, exact, licenses, lines, minhash, mixing, packing, quality, secrets, tokencount

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_minhash_neardup": minhash.query,
    "op3_exact_dedup": exact.query,
    "op4_crf_secrets": secrets.query,
    "op5_quality_resampling": quality.query,
    "op6_packing": packing.query,
    "op7_graph_ann": ann.query,
    "op8_source_mixing": mixing.query,
    "op9_license_compression": licenses.query,
    "op10_edit_token_counts": tokencount.query,
}
ORACLES = {
    "op1_line_dedup": lines.ORACLE,
    "op2_minhash_neardup": minhash.ORACLE,
    "op3_exact_dedup": exact.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
}
