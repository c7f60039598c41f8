"""The queries of the training-data operators and their SQL counterparts."""

from sparksci.llm import bpe, fill_in_middle, filter_audit, language_id, line_dedup, lm_score, near_dedup, ogg, packing, sharding, token_count, topk, url_rules

QUERIES = {
    "op1_url_rules": url_rules.op1_url_rules,
    "op2_lpt_sharding": sharding.op2_lpt_sharding,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_lm_scores": lm_score.op4_lm_scores,
    "op5_top_k": topk.op5_top_k,
    "op6_language_id": language_id.op6_language_id,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_ogg_media": ogg.op9_ogg_media,
    "op10_bpe": bpe.op10_bpe,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_token_counts": token_count.op12_token_counts,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_url_rules": url_rules.ORACLE,
    "op4_lm_scores": lm_score.ORACLE,
    "op5_top_k": topk.ORACLE,
    "op6_language_id": language_id.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
