"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import oracle

#: query: module
QUERIES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_token_files": "token_files",
    "op3_decontaminate": "decontaminate",
    "op4_pitman_yor": "pitman_yor",
    "op5_jaccard_join": "jaccard_join",
    "op6_kd_shards": "kd_shards",
    "op7_tiff": "tiff",
    "op8_mixing": "mixing",
    "op9_toxicity": "toxicity",
    "op10_html_text": "html_text",
    "op11_quality": "quality",
    "op12_vector_codes": "vector_codes",
    "op13_ranked_search": "ranked_search",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
        "op3_decontaminate": oracle.DECONTAMINATE,
        "op5_jaccard_join": oracle.JACCARD_JOIN,
        "op12_vector_codes": oracle.VECTOR_CODES,
        "op13_ranked_search": oracle.RANKED_SEARCH,
    }
