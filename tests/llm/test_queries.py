"""The registered queries: their SQL where there is some, and the columns that their contracts name."""

import pytest

import corpus_pipeline
from quern.llm.queries import ORACLES, QUERIES

CONTRACT = {
    "op1_token_count": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_html_extract": ["page_id", "url", "text", "n_chars"],
    "op3_quality": ["doc_id", "score", "kept"],
    "op4_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_lm_score": ["doc_id", "n_tokens", "log_likelihood"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_decontamination": ["doc_id", "item_id"],
    "op11_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op13_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, against_oracle):
    against_oracle(name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert set(CONTRACT[name]) <= set(df.columns)
    table = "pages" if name.startswith("op2_") else "documents"
    if not name.startswith(("op10_", "op13_")):
        assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "source_mix"]
