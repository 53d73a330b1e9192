"""The subpackage's registered queries, and their DuckDB twins where SQL can express them."""

from corvane.llm import decontaminate, dialogue, jaccard, language_model, mixing, pii, quality, runs, simhash, substrings, token_counts, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pii": pii.op4_pii,
    "op5_substrings": substrings.op5_substrings,
    "op6_language_model": language_model.op6_language_model,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_simhash": simhash.op11_simhash,
    "op12_conversation_repair": dialogue.op12_conversation_repair,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE: dict[str, str] = {"op9_quality": quality.OP9_SQL}
