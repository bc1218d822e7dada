"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import attention, decontam, langid, mixing, neardup, pii, quality, repeats, tokencount, warc

QUERIES = {
    "op1_warc_archive": warc.query,
    "op2_language_id": langid.query,
    "op3_ngram_jaccard": neardup.query,
    "op4_repeated_passages": repeats.query,
    "op5_token_counts": tokencount.query,
    "op6_quality_classifier": attention.query,
    "op7_personal_data": pii.query,
    "op8_source_mixing": mixing.query,
    "op9_decontamination": decontam.query,
    "op10_quality_rules": quality.query,
}
ORACLES = {
    "op1_warc_archive": warc.ORACLE,
    "op3_ngram_jaccard": neardup.ORACLE,
    "op4_repeated_passages": repeats.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
}
