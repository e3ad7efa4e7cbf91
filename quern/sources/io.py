"""Scans, and writes that are read back: Parquet, JSON, CSV, ORC and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load
from quern.storage import fresh_path


@query("scan_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_partkey", "l_quantity")


def roundtrip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Writes df in a format and reads it with its own schema."""
    at = fresh_path(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(at)
    return df.sparkSession.read.schema(df.schema).format(kind).options(**options).load(at)


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("roundtrip_json", _CUSTOMER)
def roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(_customers(spark, sf_dir), "json")


@query("roundtrip_csv", _CUSTOMER)
def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(_customers(spark, sf_dir), "csv", header="true")


@query("roundtrip_orc", _CUSTOMER)
def roundtrip_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(_customers(spark, sf_dir), "orc")


@query("partitioned_write", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter prunes the folders of the other values (PartitionFilters in the plan)."""
    at = fresh_path(spark, "by-flag")
    load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").write.partitionBy("l_returnflag").parquet(at)
    return spark.read.parquet(at).filter(F.col("l_returnflag") == "R")
