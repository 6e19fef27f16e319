"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_tokenizer_alignment
from .blocks import op1_main_text
from .decontaminate import op8_benchmark_decontamination
from .languages import op4_language_mixture
from .linededup import OP10_SQL, op10_line_dedup
from .linerules import OP9_SQL, op9_line_rules
from .packing import op3_packing
from .phrases import OP11_SQL, op11_collocations
from .rans import op6_rans_tokens
from .resample import op5_importance_resampling
from .simhash import op2_simhash_near_dedup
from .toxicity import op7_toxicity
from .urlrules import OP12_SQL, op12_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_packing": op3_packing,
        "op4_language_mixture": op4_language_mixture,
        "op5_importance_resampling": op5_importance_resampling,
        "op6_rans_tokens": op6_rans_tokens,
        "op7_toxicity": op7_toxicity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_line_rules": op9_line_rules,
        "op10_line_dedup": op10_line_dedup,
        "op11_collocations": op11_collocations,
        "op12_url_rules": op12_url_rules,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_rules": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_url_rules": OP12_SQL}
