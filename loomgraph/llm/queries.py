"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from loomgraph.llm import bpe, embedding_dedup, exact_dedup, fuzzy_hash, html_text, langid, lm_score, merkle, minhash, packing, pii, prefix_trie, substring_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op10_cover_tree": embedding_dedup.op10_cover_tree,
    "op9_lm_score": lm_score.op9_lm_score,
    "op2_bpe": bpe.op2_bpe,
    "op3_minhash": minhash.op3_minhash,
    "op4_langid": langid.op4_langid,
    "op5_html": html_text.op5_html,
    "op6_packing": packing.op6_packing,
    "op7_suffix_dedup": substring_dedup.op7_suffix_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_fuzzy_hash": fuzzy_hash.op12_fuzzy_hash,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op10_cover_tree": embedding_dedup.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
