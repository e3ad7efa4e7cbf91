"""Keys of texts by xxhash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load


#: The long whose own hash under Spark's seed is 0, so that what follows it is hashed under seed 0.
_TO_SEED_0 = -365884300664092260


def text_key(text: Column | str) -> Column:
    """The signed 64-bit XXH64 of the text's UTF-8 with seed 0; null stays null. xxhash64 passes each column's hash on as the next one's seed, so a constant before the text changes the seed from 42."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.xxhash64(F.lit(_TO_SEED_0).cast("bigint"), text))


#: The primes of XXH64 (fixed values).
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql(table: str, text: str, keep: str) -> str:
    """DuckDB SQL: keep, text and key, the XXH64 (seed 0) of an ASCII text of less than 32 bytes, one step a table expression."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _PRIMES)
    whole = "18446744073709551616::UHUGEINT"
    byte = lambda i: f"b[{i}]::UHUGEINT"
    number = lambda at, n: " + ".join(f"{byte(f'{at} + {i + 1}')} * {256**i}::UHUGEINT" for i in range(n))
    times = lambda x, p: f"(({x}) % {whole}) * {p} % {whole}"
    turned = lambda x, n: f"({x} * {2**n}::UHUGEINT % {whole} + {x} // {2 ** (64 - n)}::UHUGEINT)"
    steps = [f"SELECT {keep}, {text}, b, n, ({p5} + n::UHUGEINT) % {whole} AS h, 0::UHUGEINT AS x FROM (SELECT {keep}, {text}, list_transform(string_split({text}, ''), lambda c: ascii(c)) AS b, length({text}) AS n FROM {table})"]

    def step(x: str, h: str, when: str) -> None:
        steps.append(f"SELECT {keep}, {text}, b, n, h, CASE WHEN {when} THEN {x} ELSE 0::UHUGEINT END AS x FROM s{len(steps) - 1}")
        steps.append(f"SELECT {keep}, {text}, b, n, CASE WHEN {when} THEN {h} ELSE h END AS h, x FROM s{len(steps) - 1}")

    for k in range(3):
        when = f"n >= {8 * k + 8}"
        step(times(number(8 * k, 8), p2), f"xor(h, {times(turned('x', 31), p1)})", when)
        step("h", f"({times(turned('x', 27), p1)} + {p4}) % {whole}", when)
    step(f"xor(h, {times(number('n // 8 * 8', 4), p1)})", f"({times(turned('x', 23), p2)} + {p3}) % {whole}", "n & 4 = 4")
    for k in range(3):
        step(f"xor(h, {times(byte(f'n // 4 * 4 + {k + 1}'), p5)})", times(turned("x", 11), p1), f"n // 4 * 4 + {k} < n")
    step(f"xor(h, h // {2**33}::UHUGEINT)", times("x", p2), "true")
    step(f"xor(h, h // {2**29}::UHUGEINT)", times("x", p3), "true")
    step(f"xor(h, h // {2**32}::UHUGEINT)", "x", "true")
    key = f"CASE WHEN h >= {2**63}::UHUGEINT THEN (h::HUGEINT - {whole}::HUGEINT)::BIGINT ELSE h::BIGINT END"
    return "WITH " + ", ".join(f"s{k} AS ({x})" for k, x in enumerate(steps)) + f" SELECT {keep}, {text}, {key} AS key FROM s{len(steps) - 1}"


@query("fn_text_key", _xxh64_sql("customer", "c_name", "c_custkey"))
def fn_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name with its key."""
    return load(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", "c_name", text_key("c_name").alias("key"))
