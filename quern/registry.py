"""Every relational, streaming and corpus query by name, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, and its DuckDB SQL if there is one."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def sql_query(name: str, oracle: str, text: str | None = None, tables: tuple[str, ...] = ()):
    """Registers a query given as Spark SQL; ``tables`` become temporary views of a session of its own."""
    from quern.sources.tables import load

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: load(spark, sf_dir, t) for t in tables}
        return spark.sql((text or oracle).format(**{t: "{" + t + "}" for t in tables}), **frames)

    return query(name, oracle.format(**{t: t for t in tables}))(run)


def _register() -> None:
    from quern.functions import hashing, scalars, udf  # noqa: F401
    from quern.operators import aggregates, corpus, joins, ordered, pages, vectors, windows  # noqa: F401
    from quern.plans import recursion, sql  # noqa: F401
    from quern.sources import io  # noqa: F401
    from quern.streaming import events, stateful  # noqa: F401


_register()
