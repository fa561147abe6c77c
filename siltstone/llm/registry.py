"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, compression_bands, decontamination, divergence, importance, lexical_search, line_dedup, near_dedup, packing, secrets, substring_dedup, token_rollup, warc

QUERIES = {
    "op1_importance_resampling": importance.op1_importance_resampling,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_compression_bands": compression_bands.op3_compression_bands,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_rollup": token_rollup.op10_token_rollup,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
