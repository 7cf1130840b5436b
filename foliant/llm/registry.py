"""The queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from foliant.llm import byte_bpe, license_scans, line_dedup, mixing, ngram_join, nn_descent, packing, phrases, quality_classifier, quality_rules, token_counts, url_filters, whitening

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_license_scans": license_scans.query,
    "op3_source_mixing": mixing.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_url_filters": url_filters.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_line_dedup": line_dedup.query,
    "op8_nn_descent": nn_descent.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_token_counts": token_counts.query,
    "op11_embedding_whitening": whitening.query,
    "op12_phrase_collocations": phrases.query,
    "op13_best_fit_packing": packing.query,
}
ORACLES = {
    "op2_license_scans": license_scans.oracle(),
    "op3_source_mixing": mixing.oracle(),
    "op5_url_filters": url_filters.oracle(),
    "op12_phrase_collocations": phrases.oracle(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
