"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, codebooks, compression, counts, decontaminate, langid, minhash, mixing, prefixes, quality, repeats, tokens, winnow_lines

QUERIES = {
    "op1_compression_bands": compression.query,
    "op2_langid_segmentations": langid.query,
    "op3_minmax_dedup": minhash.query,
    "op4_winnow_lines": winnow_lines.query,
    "op5_chat_events": chat.query,
    "op6_random_indexing": quality.query,
    "op7_token_orc": tokens.query,
    "op8_mix_thresholds": mixing.query,
    "op9_suffix_shards": repeats.query,
    "op10_pigeonhole_edits": decontaminate.query,
    "op11_weighted_codebooks": codebooks.query,
    "op12_family_trie": prefixes.query,
    "op13_two_tier_counts": counts.query,
}
ORACLE_SQL = {"op8_mix_thresholds": mixing.ORACLE, "op11_weighted_codebooks": codebooks.ORACLE, "op12_family_trie": prefixes.ORACLE}
