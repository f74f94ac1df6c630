"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import ctw, decontamination, interactions, lines, ordered, packing, privacy, quality, ranking, rules, similarity, sstable, toxicity

QUERIES = {
    "op1_benchmark_decontamination": decontamination.query,
    "op2_quality_classifier": quality.query,
    "op3_context_tree_weighting": ctw.query,
    "op4_line_dedup": lines.query,
    "op5_quality_rules": rules.query,
    "op6_ngram_jaccard_join": similarity.query,
    "op7_best_fit_packing": packing.query,
    "op8_sstable_shards": sstable.query,
    "op9_privacy": privacy.query,
    "op10_toxicity": toxicity.query,
    "op11_filter_interactions": interactions.query,
    "op12_ordered_packing": ordered.query,
    "op13_ranked_search": ranking.query,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": decontamination.SQL,
    "op4_line_dedup": lines.SQL,
    "op5_quality_rules": rules.SQL,
    "op11_filter_interactions": interactions.SQL,
    "op13_ranked_search": ranking.SQL,
}
