"""The operators' queries and the SQL that some of them can be told by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op8_byte_bpe
from .filter_audit import op12_filter_audit
from .hmm_lm import op10_hmm_lm
from .nn_descent import op13_nn_descent
from .oracles import ORACLE_SQL
from .order_minhash import op5_order_minhash
from .packing import op2_packing
from .pii import op9_pii
from .quality_classifier import op7_quality_classifier
from .quality_rules import op1_quality_rules
from .simhash import op3_simhash
from .spelling import op11_spelling
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_order_minhash": op5_order_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pii": op9_pii,
    "op10_hmm_lm": op10_hmm_lm,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_nn_descent": op13_nn_descent,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
