"""Registry of the operators' queries, each over its whole table."""

from churnlab.llm import binary_ids, embedding_dedup, lexical_search, licenses, line_quality, lm_scoring, ngram_join, packing, substring_dedup, toxicity, vector_codes, vector_search, word_bpe

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_vector_search": vector_search.op3_vector_search,
    "op4_packing": packing.op4_packing,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_binary_ids": binary_ids.op6_binary_ids,
    "op7_word_bpe": word_bpe.op7_word_bpe,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_line_quality": line_quality.op13_line_quality,
}

ORACLE_SQL = {
    "op5_lm_scoring": lm_scoring.ORACLE_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op9_license_scan": licenses.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
