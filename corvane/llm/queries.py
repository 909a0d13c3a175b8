"""The opN_ queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from corvane.llm.decontaminate import OP1_SQL, op1_decontaminate
from corvane.llm.fingerprint import op7_fingerprint
from corvane.llm.html_extract import op5_html_extract
from corvane.llm.near_dedup import OP9_SQL, op9_near_dedup
from corvane.llm.packing import op4_packing
from corvane.llm.quality import op10_quality
from corvane.llm.suffix_dedup import op6_suffix_dedup
from corvane.llm.token_files import op3_token_files
from corvane.llm.toxicity import op2_toxicity
from corvane.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_html_extract": op5_html_extract,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_fingerprint": op7_fingerprint,
    "op8_url_filter": op8_url_filter,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op8_url_filter": OP8_SQL, "op9_near_dedup": OP9_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
