"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from gridloom.llm import op1_sharding, op2_substrings, op3_tokens, op4_mixing, op5_lm, op6_quality, op7_toxicity, op8_fingerprints, op9_jaccard, op10_decontam, op11_neighbours, op12_trie, op13_fim

QUERIES = {
    "op1_sharding": op1_sharding.query,
    "op2_substrings": op2_substrings.query,
    "op3_tokens": op3_tokens.query,
    "op4_mixing": op4_mixing.query,
    "op5_lm": op5_lm.query,
    "op6_quality": op6_quality.query,
    "op7_toxicity": op7_toxicity.query,
    "op8_fingerprints": op8_fingerprints.query,
    "op9_jaccard": op9_jaccard.query,
    "op10_decontam": op10_decontam.query,
    "op11_neighbours": op11_neighbours.query,
    "op12_trie": op12_trie.query,
    "op13_fim": op13_fim.query,
}

ORACLES = {
    "op2_substrings": op2_substrings.ORACLE,
    "op4_mixing": op4_mixing.ORACLE,
    "op9_jaccard": op9_jaccard.ORACLE,
    "op10_decontam": op10_decontam.ORACLE,
    "op11_neighbours": op11_neighbours.ORACLE,
    "op12_trie": op12_trie.ORACLE,
    "op13_fim": op13_fim.ORACLE,
}
