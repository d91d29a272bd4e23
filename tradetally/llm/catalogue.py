"""Registered queries of the subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tradetally.llm import (
    op1_decontam,
    op2_packing,
    op3_langid,
    op4_permutation,
    op5_attention_lm,
    op6_pii,
    op7_urls,
    op8_substrings,
    op9_superminhash,
    op10_toxicity,
    op11_prefix_trie,
    op12_codes,
    op13_fingerprints,
)


def queries() -> dict:
    return {
        "op1_latent_semantic_decontamination": op1_decontam.query,
        "op2_concat_and_cut": op2_packing.query,
        "op3_family_then_svm": op3_langid.query,
        "op4_permutation_index": op4_permutation.query,
        "op5_attention_lm": op5_attention_lm.query,
        "op6_bootstrapped_pii": op6_pii.query,
        "op7_host_reputation": op7_urls.query,
        "op8_prefix_suffix_trees": op8_substrings.query,
        "op9_superminhash": op9_superminhash.query,
        "op10_bidirectional_gru": op10_toxicity.query,
        "op11_sketched_prefix_trie": op11_prefix_trie.query,
        "op12_adaptive_bounds": op12_codes.query,
        "op13_closed_syncmers": op13_fingerprints.query,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {
        "op7_host_reputation": op7_urls.ORACLE_SQL,
        "op11_sketched_prefix_trie": op11_prefix_trie.ORACLE_SQL,
        "op12_adaptive_bounds": op12_codes.ORACLE_SQL,
        "op13_closed_syncmers": op13_fingerprints.ORACLE_SQL,
    }
