"""The queries of this subpackage and, where SQL can express them, their equivalents for DuckDB."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, langid, line_dedup, ngram_join, packing, pii, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_pii": pii.query,
    "op3_ann": ann.query,
    "op4_langid": langid.query,
    "op5_bpe": bpe.query,
    "op6_ngram_join": ngram_join.query,
    "op7_toxicity": toxicity.query,
    "op8_line_dedup": line_dedup.query,
    "op9_packing": packing.query,
    "op10_chat": chat.query,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op10_chat": chat.SQL,
}
