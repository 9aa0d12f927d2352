"""Driver queries of the training-data operators."""

from __future__ import annotations

from . import alignment, ann, hard_negatives, language_id, line_dedup, minhash, mixing, packing, quality_qda, quality_rules, simhash, suffix_dedup, token_count

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_packing": packing.op2_packing,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_language_id": language_id.op4_language_id,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_qda.op10_quality_classifier,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_minhash": minhash.op12_minhash,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op12_minhash": minhash.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
