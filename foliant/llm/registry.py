"""The queries of this subpackage and, where SQL can express them, the SQL for their rows."""

from __future__ import annotations

from foliant.llm import alignment, ann, divergence, html, licenses, linededup, media, mixing, packing, quality, secrets, sharding, simhash

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_nearest_vectors": ann.op3_nearest_vectors,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_simhash_golay": simhash.op5_simhash_golay,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_gam": quality.op8_quality_gam,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_media_columns": media.op10_media_columns,
    "op11_virtual_slots": sharding.op11_virtual_slots,
    "op12_token_spans": alignment.op12_token_spans,
    "op13_prefix_iceberg": divergence.op13_prefix_iceberg,
}

ORACLE_SQL = {
    "op1_secret_scan": secrets.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op4_html_extraction": html.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op13_prefix_iceberg": divergence.ORACLE,
}
