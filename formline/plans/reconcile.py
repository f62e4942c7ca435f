"""Reconciliation report of two sources of the same contests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators import joins


def match_rates(df: DataFrame, other: DataFrame, key_sets: dict[str, dict[str, str]],
                value: str, order: Sequence[str]) -> DataFrame:
    """Rows, matches and match rate under each named key set."""
    parts = []
    for name, pairs in key_sets.items():
        matched = joins.with_exact_match(df, other, pairs, [value], order)
        parts.append(joins.match_rate(matched, value).select(
            F.lit(name).alias("key_set"), "rows", "matched", "match_rate"))
    return reduce(DataFrame.unionByName, parts)
