"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat import OP7_SQL, op7_perspectives
from .fingerprint import op8_fingerprints
from .mixing import op5_mixing
from .quality import op6_quality_rules, op10_quality_classifier
from .sharding import OP2_SQL, op2_kd_sharding
from .simhash import op4_simhash_dedup
from .tokens import op9_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_perspectives": op7_perspectives,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
}
SQL = {"op2_kd_sharding": OP2_SQL, "op7_perspectives": OP7_SQL}
