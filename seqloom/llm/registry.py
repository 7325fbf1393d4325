"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from seqloom.llm import bpe, decontaminate, divergence, language, lm_score, neighbours, periodic_runs, pii, quality, simhash, token_counts, url_filter, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language_id": language.op2_language_id,
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_warc": warc.op7_warc,
    "op8_pii": pii.op8_pii,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_simhash": simhash.op10_simhash,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op6_url_filters": url_filter.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_nearest_neighbours": neighbours.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
