"""Registered corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tabflow.llm import cross_align, decontaminate, embedding_near, exact_dedup, language, line_chunks, merkle, mixing, pipeline, quality, simhash, suffix_dedup, token_counts, training_order

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_training_order": training_order.op2,
    "op3_quality_mil": quality.op3,
    "op4_line_chunks": line_chunks.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_language_id": language.op6,
    "op7_simhash_variants": simhash.op7,
    "op8_token_counts": token_counts.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_cross_align": cross_align.op12,
    "op13_embedding_pigeonhole": embedding_near.op13,
    "pipeline": pipeline.run,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_line_chunks": line_chunks.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
