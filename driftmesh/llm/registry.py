"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html, licenses, mixing, neardup, pii, quality, tokens, toxicity, urls

QUERIES = {
    "op1_html_extraction": html.query,
    "op2_token_counts": tokens.query,
    "op3_toxicity": toxicity.query,
    "op4_order_minhash": neardup.query,
    "op5_poisson_mixing": mixing.query,
    "op6_url_filters": urls.query,
    "op7_license_scan": licenses.query,
    "op8_decontamination": decontaminate.query,
    "op9_pii": pii.query,
    "op10_quality_rules": quality.query,
}
SQL: dict[str, str] = {"op5_poisson_mixing": mixing.sql(), "op6_url_filters": urls.SQL, "op10_quality_rules": quality.sql()}
