"""User-defined functions: scalar (Arrow batches), grouped aggregate, grouped map and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load


@query("udf_scalar", "SELECT p_partkey, p_size * 3 + 1 AS scaled FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("int")
    def scaled(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    return load(spark, sf_dir, "part").select("p_partkey", scaled("p_size").alias("scaled"))


def _partial(df: DataFrame, key: str, reduce, schema: str) -> DataFrame:
    """reduce(frame) of each key in each Arrow batch, so that what follows gathers a row for each key and batch, not a key's rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.groupby(key, as_index=False, sort=False).agg(**reduce)

    return df.mapInPandas(run, schema)


@query("udaf_grouped", "SELECT p_brand, (max(p_size) - min(p_size))::BIGINT AS spread FROM part GROUP BY p_brand")
def udaf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("bigint")
    def spread(low: pd.Series, high: pd.Series) -> int:
        return int(high.max() - low.min())

    parts = _partial(load(spark, sf_dir, "part", "p_brand", "p_size"), "p_brand", {"low": ("p_size", "min"), "high": ("p_size", "max")}, "p_brand string, low int, high int")
    return parts.groupBy("p_brand").agg(spread("low", "high").alias("spread"))


@query("udf_grouped_map", "SELECT p_brand, count(*)::BIGINT AS n, max(p_name) AS last_name FROM part GROUP BY p_brand")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_brand": [group.p_brand.iloc[0]], "n": [group.n.sum()], "last_name": [group.last_name.max()]})

    parts = _partial(load(spark, sf_dir, "part", "p_brand", "p_name"), "p_brand", {"n": ("p_name", "size"), "last_name": ("p_name", "max")}, "p_brand string, n bigint, last_name string")
    return parts.groupBy("p_brand").applyInPandas(one, "p_brand string, n bigint, last_name string")


@query("udf_map", "SELECT p_partkey, length(p_name)::BIGINT AS size FROM part WHERE p_size > 25")
def udf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"p_partkey": x.p_partkey, "size": x.p_name.str.len()})

    return load(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey", "p_name").mapInPandas(run, "p_partkey bigint, size bigint")


@query("udtf", "SELECT n_nationkey, i::BIGINT AS position, substring(n_name, i, 1) AS letter FROM nation, LATERAL (SELECT unnest(generate_series(1, length(n_name))) AS i)")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="position bigint, letter string")
    class Letters:
        def eval(self, name: str):
            for i, x in enumerate(name, 1):
                yield i, x

    nation = load(spark, sf_dir, "nation")
    return nation.lateralJoin(Letters(F.col("n_name").outer())).select("n_nationkey", "position", "letter")
