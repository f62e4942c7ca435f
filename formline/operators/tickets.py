"""Combination probabilities (first two or three places) of listed tickets.

Probabilities are computed for the tickets a table lists, by equi-joins on
(contest, entry); the combinations of a contest are never enumerated.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S

TINY = 1e-9  # fixed value: keeps the conditional denominators positive


def exacta_probability(p1: Column, p2: Column) -> Column:
    return p1 * (p2 / (1.0 - p1 + TINY))


def trifecta_probability(p1: Column, p2: Column, p3: Column) -> Column:
    return exacta_probability(p1, p2) * (p3 / (1.0 - p1 - p2 + TINY))


def _any_order(parts: list[Column], rule) -> Column:
    total = F.lit(0.0)
    for order in permutations(parts):
        total = total + rule(*order)
    return total


def with_ticket_probabilities(tickets: DataFrame, entrants: DataFrame, *,
                              contest: str = "race_id", entry: str = "horse_num",
                              prob: str = "pred_prob",
                              legs: tuple[str, ...] = ("h1", "h2")) -> DataFrame:
    """Add exacta/quinella (two legs) or trifecta/trio (three legs) probabilities.

    Tickets that repeat an entrant have none.
    """
    out = tickets
    for leg in legs:
        # Hashing contest and entry together spreads even one huge contest.
        side = entrants.select(F.col(contest), F.col(entry).alias(leg),
                               F.col(prob).alias(f"p_{leg}"))
        out = out.join(side, [contest, leg], "left")
    ps = [F.col(f"p_{leg}") for leg in legs]
    distinct = S.all_of(*[F.col(a) != F.col(b) for i, a in enumerate(legs)
                          for b in legs[i + 1:]])
    ordered, unordered, rule = (
        ("exacta", "quinella", exacta_probability) if len(legs) == 2
        else ("trifecta", "trio", trifecta_probability))
    return out.withColumns({
        ordered: F.when(distinct, rule(*ps)),
        unordered: F.when(distinct, _any_order(ps, rule)),
    }).drop(*[f"p_{leg}" for leg in legs])


def combined_by_set(tickets: DataFrame, *, contest: str = "race_id",
                    legs: tuple[str, ...] = ("h1", "h2"), value: str = "exacta") -> DataFrame:
    """Sum an ordered-ticket value over the orders listed for the same set of entrants."""
    combo = F.array_sort(F.array(*legs)).alias("combo")
    return tickets.groupBy(contest, combo).agg(F.sum(value).alias(value))
