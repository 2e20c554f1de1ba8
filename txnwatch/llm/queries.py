"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from txnwatch.llm import alignment, exact_dedup, language_id, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, spelling, token_counts, url_filter, warc, word_bpe

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_packing": packing.op6_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_warc": warc.op9_warc,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.op1_sql(),
    "op4_url_filter": url_filter.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
