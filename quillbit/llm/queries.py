"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from quillbit.llm import backoff_lm, decontaminate, line_dedup, pii_feistel, quality_model, quality_rules, sentencepiece_viterbi, simhash, toxicity, warc_store

QUERIES = {
    "op1_sentencepiece": sentencepiece_viterbi.query,
    "op2_decontamination": decontaminate.query,
    "op3_toxicity": toxicity.query,
    "op4_quality": quality_model.query,
    "op5_lm_score": backoff_lm.query,
    "op6_quality_rules": quality_rules.query,
    "op7_simhash": simhash.query,
    "op8_line_dedup": line_dedup.query,
    "op9_warc": warc_store.query,
    "op10_pii": pii_feistel.query,
}

ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_warc": warc_store.ORACLE,
}
