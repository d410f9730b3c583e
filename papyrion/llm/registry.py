"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from papyrion.llm import bpe, chat, decontam, licenses, neardup, packing, pii, quality, resampling, tokenfiles, urls, warc, whitening

QUERIES = {
    "op1_ngram_jaccard_join": neardup.op1_ngram_jaccard_join,
    "op2_packing": packing.op2_packing,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_warc": warc.op6_warc,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_pii": pii.op8_pii,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_url_filters": urls.op10_url_filters,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_bpe_codec": bpe.op12_bpe_codec,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {
    "op1_ngram_jaccard_join": neardup.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_pii": pii.OP8_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "op10_url_filters": urls.OP10_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
}
