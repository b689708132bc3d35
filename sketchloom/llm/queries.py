"""The queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from .embed_dedup import op7_multi_index
from .exact_dedup import OP12_SQL, op12_golomb_exchange
from .line_dedup import OP3_SQL, op3_line_dedup
from .lm_score import op5_cross_entropy
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import op6_block_mix
from .packing import op8_vector_best_fit
from .phrases import OP11_SQL, op11_suffix_sigma
from .pii import op4_candidate_boost
from .quality_rules import op10_quality_rules
from .quality_subword import op1_quality_subword
from .simhash_vp import op9_simhash_vp
from .toxicity import op2_ordinal_toxicity

QUERIES = {
    "op1_quality_subword": op1_quality_subword,
    "op2_ordinal_toxicity": op2_ordinal_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_candidate_boost": op4_candidate_boost,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_block_mix": op6_block_mix,
    "op7_multi_index": op7_multi_index,
    "op8_vector_best_fit": op8_vector_best_fit,
    "op9_simhash_vp": op9_simhash_vp,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_sigma": op11_suffix_sigma,
    "op12_golomb_exchange": op12_golomb_exchange,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op11_suffix_sigma": OP11_SQL,
    "op12_golomb_exchange": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
