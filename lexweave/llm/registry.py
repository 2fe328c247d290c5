"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import chat, decontamination, mixing, near_copies, pii, quality, secret_scan, sharding, substrings, token_alignment, topk_search, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_automaton_decontamination": decontamination.op1_suffix_automaton_decontamination,
        "op2_skip_chain_pii": pii.op2_skip_chain_pii,
        "op3_keyword_secrets": secret_scan.op3_keyword_secrets,
        "op4_event_sourced_chat": chat.op4_event_sourced_chat,
        "op5_llr_quality": quality.op5_llr_quality,
        "quality_base_rules": quality.quality_base_rules,
        "op6_adaptive_prefix_jaccard": near_copies.op6_adaptive_prefix_jaccard,
        "op7_factorization_toxicity": toxicity.op7_factorization_toxicity,
        "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
        "op9_soft_membership_mixing": mixing.op9_soft_membership_mixing,
        "op10_block_anchor_substrings": substrings.op10_block_anchor_substrings,
        "op11_ball_tree_topk": topk_search.op11_ball_tree_topk,
        "op12_union_find_alignment": token_alignment.op12_union_find_alignment,
        "op13_welford_whitening": whitening.op13_welford_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_automaton_decontamination": decontamination.ORACLE,
        "op4_event_sourced_chat": chat.ORACLE,
        "quality_base_rules": quality.ORACLE_BASE,
        "op6_adaptive_prefix_jaccard": near_copies.ORACLE,
        "op10_block_anchor_substrings": substrings.ORACLE,
        "op11_ball_tree_topk": topk_search.ORACLE,
    }
