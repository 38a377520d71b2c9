"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, html_text, language_id, lexical_search, license_scan, mixing, ngram_join, pii, substring_dedup, suffix_dedup, url_filter
from .common import table

QUERIES = {
    "op1_decontamination": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_license_scan": lambda spark, d: license_scan.licence_scan(table(spark, d, "documents")),
    "op3_ngram_join": lambda spark, d: ngram_join.jaccard_components(table(spark, d, "documents")),
    "op4_substring_dedup": lambda spark, d: substring_dedup.without_repeats(table(spark, d, "documents")).drop("kept_text"),
    "op5_language_id": lambda spark, d: language_id.identified(table(spark, d, "documents")),
    "op6_html_text": lambda spark, d: html_text.extracted(table(spark, d, "pages")),
    "op7_mixing": lambda spark, d: mixing.mixed_rows(table(spark, d, "documents").select("doc_id", "source")),
    "op8_pii": lambda spark, d: pii.personal_data(table(spark, d, "documents")),
    "op9_url_filter": lambda spark, d: url_filter.url_verdicts(table(spark, d, "pages")),
    "op10_exact_dedup": lambda spark, d: exact_dedup.duplicate_groups(table(spark, d, "documents")),
    "op11_lexical_search": lambda spark, d: lexical_search.ranked(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_fill_middle": lambda spark, d: fill_middle.digests(table(spark, d, "documents")),
    "op13_suffix_dedup": lambda spark, d: suffix_dedup.without_repeats(table(spark, d, "documents")).drop("kept"),
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op9_url_filter": url_filter.oracle(),
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
