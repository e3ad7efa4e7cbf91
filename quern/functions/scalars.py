"""Scalar functions: strings, dates, numbers, arrays, maps, JSON, hashes and nulls. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load


@query("fn_string", r"""SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substring(c_name, 10, 4) AS part, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, trim('  ' || c_mktsegment || ' ') AS trimmed,
    replace(c_name, '#', '-') AS swapped, split_part(c_name, '#', 2) AS number, regexp_extract(c_name, '0*([1-9][0-9]*)', 1) AS digits, regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g') AS masked,
    levenshtein(c_mktsegment, 'BUILDING')::BIGINT AS edits, length(c_name)::BIGINT AS size, reverse(c_mktsegment) AS turned, starts_with(c_mktsegment, 'B') AS with_b, strpos(c_name, '#')::BIGINT AS hash_at FROM customer""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(seg).alias("up"), F.lower(name).alias("low"), F.substring(name, 10, 4).alias("part"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"),
        F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("trimmed"), F.replace(name, F.lit("#"), F.lit("-")).alias("swapped"), F.split_part(name, F.lit("#"), F.lit(2)).alias("number"),
        F.regexp_extract(name, "0*([1-9][0-9]*)", 1).alias("digits"), F.regexp_replace(seg, "[AEIOU]", "*").alias("masked"), F.levenshtein(seg, F.lit("BUILDING")).cast("bigint").alias("edits"),
        F.length(name).cast("bigint").alias("size"), F.reverse(seg).alias("turned"), F.startswith(seg, F.lit("B")).alias("with_b"), F.instr(name, "#").cast("bigint").alias("hash_at"),
    )


@query("fn_date", """SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, (dayofweek(o_orderdate) + 1)::BIGINT AS dow, quarter(o_orderdate)::BIGINT AS q,
    CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::BIGINT AS since,
    strftime(o_orderdate, '%Y-%m-%d') AS written, last_day(o_orderdate) AS month_end FROM orders""")
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    big = lambda c, name: c.cast("bigint").alias(name)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", big(F.year(d), "y"), big(F.month(d), "m"), big(F.dayofmonth(d), "d"), big(F.dayofweek(d), "dow"), big(F.quarter(d), "q"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"),
        F.date_add(d.cast("date"), 30).alias("due"), big(F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")), "since"), F.date_format(d, "yyyy-MM-dd").alias("written"), F.last_day(d.cast("date")).alias("month_end"),
    )


@query("fn_math", """SELECT p_partkey, round(p_retailprice, 1) AS r1, floor(p_retailprice)::BIGINT AS fl, ceil(p_retailprice)::BIGINT AS ce, round(sqrt(p_retailprice), 6) AS root, round(pow(p_size, 2), 6) AS square,
    round(ln(p_size), 9) AS natural, round(log10(p_size), 9) AS ten, p_partkey % 7 AS remainder, abs(p_size - 25)::BIGINT AS off, sign(p_size - 25)::BIGINT AS side, greatest(p_size, 10)::BIGINT AS at_least, round(exp(p_size / 50.0), 9) AS grown FROM part""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    big = lambda c, name: c.cast("bigint").alias(name)
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.round(price, 1).alias("r1"), big(F.floor(price), "fl"), big(F.ceil(price), "ce"), F.round(F.sqrt(price), 6).alias("root"), F.round(F.pow(size, F.lit(2)), 6).alias("square"),
        F.round(F.log(size), 9).alias("natural"), F.round(F.log10(size), 9).alias("ten"), (F.col("p_partkey") % 7).alias("remainder"), big(F.abs(size - 25), "off"), big(F.signum(size - 25), "side"), big(F.greatest(size, F.lit(10)), "at_least"),
        F.round(F.exp(size / F.lit(50.0)), 9).alias("grown"),
    )


@query("fn_array", """SELECT p_partkey, len(w)::BIGINT AS n, array_to_string(list_transform(w, lambda x: upper(x)), '|') AS shouted, array_to_string(list_filter(w, lambda x: length(x) > 4), '|') AS long_words,
    list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS letters, w[1] AS head, array_to_string(list_sort(w), '|') AS sorted, list_contains(w, 'blue') AS has_blue FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return load(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w")).select(
        "p_partkey", F.size(w).cast("bigint").alias("n"), F.array_join(F.transform(w, F.upper), "|").alias("shouted"), F.array_join(F.filter(w, lambda x: F.length(x) > 4), "|").alias("long_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("letters"), F.element_at(w, 1).alias("head"), F.array_join(F.array_sort(w), "|").alias("sorted"), F.array_contains(w, "blue").alias("has_blue"),
    )


@query("fn_explode", "SELECT p_partkey, i::BIGINT AS position, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)")
def fn_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("position", "word")).select("p_partkey", F.col("position").cast("bigint").alias("position"), "word")


@query("fn_map", """SELECT p_partkey, p_brand AS brand, 2::BIGINT AS n, 'brand,type' AS names, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END::BIGINT AS promo_entries FROM part""")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("brand"), F.lit("type")), F.array("p_brand", "p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select(
        "p_partkey", F.element_at("m", F.lit("brand")).alias("brand"), F.size(F.map_values("m")).cast("bigint").alias("n"), F.array_join(F.sort_array(F.map_keys("m")), ",").alias("names"),
        F.size(F.map_filter("m", lambda k, v: v == "PROMO")).cast("bigint").alias("promo_entries"),
    )


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_typed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_variant FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.from_json("props", "k bigint")["k"].alias("k_typed"), F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_variant")
    )


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("fn_null", """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, nullif(c_nationkey, 3) AS nation, greatest(nullif(c_nationkey, 3), 5) AS most, (nullif(c_nationkey, 3) IS NULL) AS missing FROM customer""")
def fn_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.nullif(F.col("c_nationkey"), F.lit(3))
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"), nation.alias("nation"), F.greatest(nation, F.lit(5)).alias("most"), nation.isNull().alias("missing")
    )
