"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cotraining import op1_cotraining
from .embedding_dedup import ORACLE_OP8, op8_embedding_near_dedup
from .line_dedup import ORACLE_OP5, op5_line_dedup
from .near_dedup import ORACLE_OP3, op3_minhash_near_dedup
from .packing import op6_best_fit_packing
from .piece_lattice import op10_piece_lattice
from .pii import op9_pii
from .quality_rules import ORACLE_OP4, op4_quality_rules
from .revisits import ORACLE_OP7, op7_warc_revisits
from .suffix_dedup import ORACLE_OP2, op2_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_pii": op9_pii,
    "op10_piece_lattice": op10_piece_lattice,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": ORACLE_OP2,
    "op3_minhash_near_dedup": ORACLE_OP3,
    "op4_quality_rules": ORACLE_OP4,
    "op5_line_dedup": ORACLE_OP5,
    "op7_warc_revisits": ORACLE_OP7,
    "op8_embedding_near_dedup": ORACLE_OP8,
}
