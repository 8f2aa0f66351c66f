"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from webloom.llm import chat, decontam, jaccard, knn, langid, lines, mixing, pii, secrets, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_language_id": langid.op3_language_id,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_benchmark_decontamination": decontam.op5_benchmark_decontamination,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_exact_top_k": knn.op9_exact_top_k,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op9_exact_top_k": knn.OP9_SQL,
}
