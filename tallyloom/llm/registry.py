"""Queries and oracle SQL of the llm operators."""

from __future__ import annotations

from tallyloom.llm import bpe, clustering, conversation_repair, decontaminate, exact_dedup, katz, langid, line_dedup, near_dedup, pii, substring_dedup, token_counts, toxicity

QUERIES = {
    "op9_repeated_bytes": substring_dedup.op9_repeated_bytes,
    "op1_katz_scores": katz.op1_katz_scores,
    "op10_minhash_groups": near_dedup.op10_minhash_groups,
    "op8_toxicity": toxicity.op8_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op5_benchmark_leaks": decontaminate.op5_benchmark_leaks,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op7_site_line_dedup": line_dedup.op7_site_line_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_centroid_clusters": clustering.op12_centroid_clusters,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLE_SQL = {
    "op7_site_line_dedup": line_dedup.OP7_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_centroid_clusters": clustering.OP12_SQL,
}
