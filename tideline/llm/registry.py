"""The queries of this subpackage, by the names that __spark_entry__.py registers."""

from __future__ import annotations

from . import bpe, byte_cnn, decontaminate, edit_counts, jaccard, licenses, line_dedup, nn_descent, oracles, secrets, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_embedding_near_dedup": nn_descent.op2,
    "op3_toxicity": toxicity.op3,
    "op4_quality": byte_cnn.op4,
    "op5_edit_token_counts": edit_counts.op5,
    "op6_secret_scan": secrets.op6,
    "op7_ngram_jaccard": jaccard.op7,
    "op8_byte_bpe": bpe.op8,
    "op9_license_scan": licenses.op9,
    "op10_line_dedup": line_dedup.op10,
    # What SQL can express of an operator whose full result it can't.
    "license_base": lambda spark, sf_dir: licenses.op9(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
}

#: The queries that have none are tested against brute force, known results, a round trip or held-out labels.
ORACLES: dict[str, str] = oracles.SQL
