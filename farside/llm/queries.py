"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embeddings, lines, media, mixing, periodic, pieces, pii, simhash, suffixes, toxicity, tries, urls

QUERIES = {
    "op1_embedding_dedup": embeddings.op1_embedding_dedup,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_audio": media.op9_audio,
    "op10_simhash": simhash.op10_simhash,
    "op11_runs": periodic.op11_runs,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_prefix_trie": tries.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": mixing.SQL,
    "op13_prefix_trie": tries.SQL,
}
