"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the terms of a text, spelled out apart from the code that it checks.
TERMS = """list_filter(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+(?:_[a-z0-9]+)*|[㐀-䶿一-鿿]+'), lambda x: length(x) > 1 AND x NOT IN (
'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'can', 'does', 'for', 'from', 'give', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'their', 'this', 'to', 'use', 'what', 'when', 'which', 'why', 'with'))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
