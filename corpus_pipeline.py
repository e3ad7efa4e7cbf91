"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents. Rows are told
apart by doc_id and, where a verdict depends on the text, by the text's hash, so repeated and null ids do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_stored, stored, text_column
from quern.llm.decontamination import LEAST_ITEM, leaks
from quern.llm.near_dedup import near_groups
from quern.llm.quality_rules import quality_rules
from quern.llm.secret_scan import redact
from quern.llm.source_mix import mix_sources
from quern.sources.tables import load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame, key: list[F.Column]) -> DataFrame:
    """The rows of docs whose key isn't a row of gone; the key's columns in the order of gone's, null equal to null."""
    names = [f"_gone_{uuid.uuid4().hex}" for _ in key]  # no column of docs has such a name
    met = [k.eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)]
    cond = met[0]
    for m in met[1:]:
        cond = cond & m
    return docs.join(gone.toDF(*names).distinct(), cond, "left_anti")


def _own(*columns: str) -> F.Column:
    """A hash that tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    own = _own("text", "lang", "source")
    verdicts = quality_rules(docs.withColumn("doc_id", F.struct("doc_id", own.alias("own"))))
    gone = stored(verdicts.filter(~F.col("kept")).select("doc_id.doc_id", "doc_id.own"), "rejected")
    return _without(docs, gone, [F.col("doc_id"), own])


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id and text hash; a repeated row stays once."""
    groups = stored(near_groups(docs).select("doc_id", "own", "leads"), "groups")
    left = _without(docs, groups.filter(~F.col("leads")).select("doc_id", "own"), [F.col("doc_id"), _own("text")])
    if groups.filter("doc_id is not null").groupBy("doc_id", "own").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id is null").union(left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; one of fewer than LEAST_ITEM words must be all that the document says."""
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), _own("text").alias("own"), text_column(docs).alias("text"))
    found = leaks(base, load(spark, sf_dir, "benchmark")).filter((F.col("item_words") >= LEAST_ITEM) | (F.col("item_words") == F.col("doc_words")))
    return _without(docs, stored(found.select("doc_id", "own"), "leaks"), [F.col("doc_id"), _own("text")])


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark; n_chars follows the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left."""
    return mix_sources(docs)


STAGES = [("quality_rules", _quality), ("near_dedup", _near), ("decontamination", _clean), ("secret_scan", _secrets), ("source_mix", _mix)]

#: Sketches, banding, edit distances and Newton's iterations aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what is between them goes to the shared folder."""
    docs = load(spark, sf_dir, "documents", *COLUMNS)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
