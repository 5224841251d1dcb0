"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from wheelwork.llm import chat, decontaminate, infill, jaccard, licenses, lloyd, packing, quality, repeats, sharding, sstable, toxicity, warc

QUERIES = {
    "op1_sstable_ids": sstable.op1_sstable_ids,
    "op10_vertical_jaccard": jaccard.op10_vertical_jaccard,
    "op11_warc_archives": warc.op11_warc_archives,
    "op12_parallel_infill": infill.op12_parallel_infill,
    "op13_dual_tree_lloyd": lloyd.op13_dual_tree_lloyd,
    "op2_license_rules": licenses.op2_license_rules,
    "op3_two_pass_shuffle": sharding.op3_two_pass_shuffle,
    "op4_suffix_automaton": decontaminate.op4_suffix_automaton,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_prefix_free_parsing": repeats.op6_prefix_free_parsing,
    "op7_typed_parts_chat": chat.op7_typed_parts_chat,
    "op8_nnls_packing": packing.op8_nnls_packing,
    "op9_factorization_machine": toxicity.op9_factorization_machine,
}
SQL = {
    "op10_vertical_jaccard": jaccard.OP10_SQL,
    "op11_warc_archives": warc.OP11_SQL,
    "op12_parallel_infill": infill.OP12_SQL,
    "op13_dual_tree_lloyd": lloyd.op13_sql(),
    "op4_suffix_automaton": decontaminate.OP4_SQL,
    "op5_quality_rules": quality.op5_sql(),
    "op7_typed_parts_chat": chat.OP7_SQL,
}
