"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, codes, interaction, jaccard, mixing, pieces, rules, simhash, tokencount, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.query,
    "op2_quality_rules": rules.query,
    "op3_token_files": tokens.query,
    "op4_simhash": simhash.query,
    "op5_warc_archive": warc.query,
    "op6_exact_topk": topk.query,
    "op7_perplexity_classifier": classifier.query,
    "op8_chat_format": chat.query,
    "op9_token_counts": tokencount.query,
    "op10_sentencepiece": pieces.query,
    "op11_vector_codes": codes.query,
    "op12_ngram_jaccard": jaccard.query,
    "op13_filter_audit": interaction.query,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_quality_rules": rules.ORACLE,
    "op5_warc_archive": warc.ORACLE,
    "op6_exact_topk": topk.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_ngram_jaccard": jaccard.ORACLE,
    "op13_filter_audit": interaction.ORACLE,
}
