"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import decontamination, licenses, line_dedup, mixing, pii, simhash, suffix_tree, token_files, topk, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_topk": topk.op3_topk,
        "op4_lm_scoring": suffix_tree.op4_lm_scoring,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_pii": pii.op6_pii,
        "op7_token_files": token_files.op7_token_files,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_licenses": licenses.op9_licenses,
        "op10_decontamination": decontamination.op10_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": topk.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op8_mix_sources": mixing.SQL,
        "op10_decontamination": decontamination.SQL,
    }
