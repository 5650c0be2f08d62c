"""The queries of this subpackage, and their SQL where SQL can express them."""

from tabulon.llm import byte_bpe, chat_windows, embedding_whitening, golden_record, line_dedup, mixing, ngram_join, quality_fm, quality_rules, secret_scan, url_filters, warc, winnowing

QUERIES = {
    "op1_quality_fm": quality_fm.query,
    "op2_url_filters": url_filters.query,
    "op3_chat_windows": chat_windows.query,
    "op4_winnowing": winnowing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_temperature_mixing": mixing.query,
    "op7_ngram_join": ngram_join.query,
    "op8_warc": warc.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_line_dedup": line_dedup.query,
    "op11_embedding_whitening": embedding_whitening.query,
    "op12_golden_record": golden_record.query,
    "op13_secret_scan": secret_scan.query,
}

ORACLE_SQL = {
    "op2_url_filters": url_filters.SQL,
    "op3_chat_windows": chat_windows.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_temperature_mixing": mixing.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_warc": warc.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_golden_record": golden_record.SQL,
}
