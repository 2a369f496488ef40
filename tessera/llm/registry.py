"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tessera.llm import op1_decontaminate as op1
from tessera.llm import op2_wrappers as op2
from tessera.llm import op3_lines as op3
from tessera.llm import op4_topk as op4
from tessera.llm import op5_hmm as op5
from tessera.llm import op6_jaccard as op6
from tessera.llm import op7_quality as op7
from tessera.llm import op8_language as op8
from tessera.llm import op9_packing as op9
from tessera.llm import op10_licenses as op10


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": op1.op1_benchmark_decontamination,
        "op2_html_wrappers": op2.op2_html_wrappers,
        "op3_line_dedup": op3.op3_line_dedup,
        "op4_topk_threshold": op4.op4_topk_threshold,
        "op5_hmm_scoring": op5.op5_hmm_scoring,
        "op6_jaccard_join": op6.op6_jaccard_join,
        "op7_quality_crf": op7.op7_quality_crf,
        "op8_language_fusion": op8.op8_language_fusion,
        "op9_best_fit_packing": op9.op9_best_fit_packing,
        "op10_license_scan": op10.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": op3.ORACLE,
        "op4_topk_threshold": op4.ORACLE,
        "op10_license_scan": op10.ORACLE,
    }
