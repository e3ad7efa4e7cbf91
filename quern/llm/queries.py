"""The training-data queries opN_<name>, each over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.cotraining import quality
from quern.llm.decontamination import contaminated
from quern.llm.divergence import divergence
from quern.llm.html_extract import extract
from quern.llm.language_id import identify
from quern.llm.lm_score import lm_scores
from quern.llm.merkle import manifest
from quern.llm.near_dedup import near_duplicates
from quern.llm.oracles import DIVERGENCE, MANIFEST, NEAR_DEDUP, QUALITY_RULES
from quern.llm.quality_rules import quality_rules
from quern.llm.secret_scan import secret_scan
from quern.llm.source_mix import mix_sources
from quern.llm.token_count import token_counts
from quern.llm.toxicity import toxicity
from quern.sources.tables import load

QUERIES = {}
ORACLES = {"op4_near_dedup": NEAR_DEDUP, "op7_quality_rules": QUALITY_RULES, "op11_merkle_manifest": MANIFEST, "op13_source_divergence": DIVERGENCE}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
