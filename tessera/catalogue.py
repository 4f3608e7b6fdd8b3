"""The registry of catalogue queries, each with the SQL that must give the same rows.

Most queries are SQL that Spark and the oracle both read, so they are written
once; where the two spell a thing differently, or the DataFrame API is the
point, the Spark side is given apart. The queries live in ``tessera.plans``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
MODULES = ("scans", "predicates", "joins", "aggregates", "windows", "ordering", "sets", "scalars", "vectors", "star")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the oracle's SQL."""

    def register(f: Query) -> Query:
        return _add(f.__name__, f, oracle)

    return register


def sql(name: str, text: str, spark: str | None = None) -> Query:
    """Register SQL; ``spark`` replaces it on the Spark side."""
    own = spark or text
    used = [t for t in TABLES if re.search(rf"\b{t}\b", own)]

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(session, sf_dir, t).createOrReplaceTempView(t)
        return session.sql(own)

    run.__name__ = name
    return _add(name, run, text)


def _add(name: str, f: Query, oracle: str | None) -> Query:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = f
    if oracle is not None:
        _ORACLES[name] = oracle
    return f


def _load() -> None:
    for m in MODULES:
        import_module(f"tessera.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
