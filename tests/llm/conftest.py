"""Documents that an operator must survive: nulls in any column, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

import pytest

SYLLABLES = ["an", "the", "re", "tion", "ou", "er", "hen", "is", "or", "ble", "at", "wh", "ing", "st"]
#: Names that operators use inside, as further columns of the input.
CLASHES = ("row", "key", "n", "w", "h", "kept", "size", "target", "taken", "spans", "base", "score", "component", "rep", "a", "b", "s", "l", "copies", "part", "own", "id", "value", "held_out", "rate")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    long_text = prose(99, 30_000)
    return [
        (0, prose(1, 80), "en", "a"), (1, prose(1, 80), "en", "a"), (2, prose(1, 80) + " extra", "en", "b"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "en", None), (None, prose(2, 60), None, None), (None, None, None, None),
        (6, long_text, "de", "a"), (7, long_text + " tail", "de", "b"), (8, "one two three", "fr", "b"), (9, "one two three", "fr", "c"),
        (10, "same line here\n" * 40, "en", "c"), (11, prose(3, 200), "es", "é"), (11, prose(3, 200), "es", "é"), (12, "#" * 500, "en", "a"), (13, "word", "en", "a"),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, clash: bool = False):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})
    return df


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, edge_rows(), clash=True)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])
