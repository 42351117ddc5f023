"""Queries of the corpus operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import chaining, decontamination, exact_dedup, line_dedup, negatives, packing, sharding, simhash, suffix_dedup, token_count, toxicity, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op10_collinear_chaining": chaining.op10_collinear_chaining,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_external_shuffle": sharding.op12_external_shuffle,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc": warc.op8_warc,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
}
SQL = {"op1_line_dedup": line_dedup.SQL, "op3_exact_dedup": exact_dedup.SQL, "op8_warc": warc.SQL, "op11_vector_codes": vector_codes.SQL, "op13_hard_negatives": negatives.SQL}
