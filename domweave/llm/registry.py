"""The queries of the training-data operators, and SQL for those that SQL can express."""

from domweave.llm import compression, line_dedup, mixing, packing, pii, simhash, substring_dedup, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_pii": pii.op3_pii,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_compression_bands": compression.op5_compression_bands,
    "op6_warc_archive": warc.op6_warc_archive,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {"op2_exact_top_k": topk.SQL, "op6_warc_archive": warc.SQL, "op7_substring_dedup": substring_dedup.SQL, "op9_line_dedup": line_dedup.SQL, "op10_mixing": mixing.SQL}
