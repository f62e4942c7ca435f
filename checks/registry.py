"""Queries and, where SQL can say the same, their oracle statements."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Register a query; ``doubles`` are rounded alike on both sides."""
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits)
                                   for c in doubles}) if doubles else df
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"'
                                for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if doubles else sql
        return fn
    return add
