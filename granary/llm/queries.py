"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import balls, binary, bpe, exact, mining, nbsvm, nnpu, packing, pii, records, simhash, substring, topk

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": nbsvm.op2_quality,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_token_records": records.op4_token_records,
    "op5_toxicity": nnpu.op5_toxicity,
    "op6_top_k": topk.op6_top_k,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_pii": pii.op10_pii,
    "op11_binary_packing": binary.op11_binary_packing,
    "op12_hard_negatives": mining.op12_hard_negatives,
    "op13_ball_k_means": balls.op13_ball_k_means,
}

ORACLE_SQL = {"op6_top_k": topk.OP6_SQL, "op8_substring_dedup": substring.OP8_SQL, "op9_exact_dedup": exact.OP9_SQL, "op12_hard_negatives": mining.OP12_SQL, "op13_ball_k_means": balls.OP13_SQL}
