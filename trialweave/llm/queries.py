"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from trialweave.llm import (chat, hilbert, merkle, mixing, multiset_hash, packing, passages, prefix_trie,
                            sentencepieces, sharding, simhash, suffix_dedup, toxicity)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_multiset_hash": multiset_hash.query,
    "op3_sentencepiece": sentencepieces.query,
    "op4_sharding": sharding.query,
    "op5_suffix_arrays": suffix_dedup.query,
    "op6_mixing": mixing.query,
    "op7_passages": passages.query,
    "op8_hilbert": hilbert.query,
    "op9_chat": chat.query,
    "op10_simhash": simhash.query,
    "op11_merkle": merkle.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_packing": packing.query,
}

ORACLES = {
    "op6_mixing": mixing.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
