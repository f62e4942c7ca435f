"""Decisions from scored rows: value filters, stakes, named scenarios, allocation, tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.skew import OrderedRows

# Fixed values of the plain policy.
MAX_PRICE, MIN_PROB, STAKE, DEFAULT_EV = 100.0, 0.05, 100, 2.0
KELLY_CAP, KELLY_MINIMUM = 0.5, 100


@dataclass(frozen=True)
class Scenario:
    name: str
    method: str = "fixed_amount"  # or ev_weighted, proportional
    amount: int = 100
    min_ev: float = 1.0
    min_prob: float = 0.0
    max_prob: float = 1.0
    min_price: float = 1.0
    max_price: float = 1000.0


# The seven named scenarios.
SCENARIOS = (
    Scenario("Standard (EV>1.2)", min_ev=1.2),
    Scenario("Conservative (EV>1.5)", min_ev=1.5),
    Scenario("Confident (Prob>0.3)", min_prob=0.3),
    Scenario("Longshot (Odds>20)", min_price=20.0, max_price=100.0),
    Scenario("Aggressive (EV Weighted)", method="ev_weighted", min_ev=1.2),
    Scenario("Scientific (Kelly Criterion)", method="proportional", amount=100000),
    Scenario("Ultra High EV (>3.0)", min_ev=3.0),
)
# Tier -> (sign, class), by least EV.
TIERS = ((2.3, "◎", "strong-buy"), (1.5, "○", "buy"), (1.2, "△", "watch"))


def safe_bet(prob: str | Column, price: str | Column, min_ev: float | Column = DEFAULT_EV,
             max_price: float = MAX_PRICE, min_prob: float = MIN_PROB) -> Column:
    p, o = S.col(prob), S.col(price)
    return (p * o > min_ev) & (o <= max_price) & (p >= min_prob)


def decide_bets(preds: DataFrame, prices: DataFrame | None = None, *,
                min_ev: float = DEFAULT_EV, contest: str = "race_id",
                entry: str = "horse_num", prob: str = "pred_prob",
                price: str = "odds") -> DataFrame:
    """Fixed-stake win bets that pass the safety filters; entrants without a price drop out.

    ``prices`` may hold newer prices per (contest, entry).
    """
    if prices is not None:
        newest = prices.select(contest, entry, F.col(price).alias("_price"))
        preds = preds.drop(price).join(newest, [contest, entry]) \
            .withColumnRenamed("_price", price)
    return preds.where(safe_bet(prob, price, min_ev)).select(
        contest, entry, F.lit("tansho").alias("type"), F.lit(STAKE).alias("amount"))


def scenario_fits(s: Scenario, prob: Column, price: Column) -> Column:
    """Filters of a scenario; limits are inclusive, the value must exceed its threshold."""
    return (prob.between(s.min_prob, s.max_prob) & price.between(s.min_price, s.max_price)
            & (prob * price > s.min_ev))


def scenario_stake(method: str, amount: int, prob: Column, price: Column) -> Column:
    """Stake under a stake method; 0 means no bet."""
    if method == "ev_weighted":
        return F.floor(F.lit(amount) * (prob * price)).cast("long")
    if method == "proportional":
        scaled = F.floor(F.lit(amount) * F.least(S.kelly_fraction(prob, price),
                                                 F.lit(KELLY_CAP))).cast("long")
        return F.when(scaled >= KELLY_MINIMUM, scaled).otherwise(F.lit(0).cast("long"))
    return F.lit(amount).cast("long")


def scenario_bets(preds: DataFrame, scenarios: Sequence[Scenario] = SCENARIOS, *,
                  prob: str = "pred_prob", price: str = "odds",
                  keep: Sequence[str] = ("race_id", "horse_num", "rank")) -> DataFrame:
    """One row per bet and scenario with its stake."""
    p, o = F.col(prob), F.col(price)
    offers = F.array(*[F.when(scenario_fits(s, p, o), F.struct(
        F.lit(s.name).alias("scenario"),
        scenario_stake(s.method, s.amount, p, o).alias("stake"))) for s in scenarios])
    return preds.select(*keep, prob, price, F.explode(offers).alias("_b")) \
        .where(F.col("_b.stake") > 0).select(*keep, prob, price, "_b.scenario", "_b.stake")


def with_tier(df: DataFrame, prob: str = "pred_prob", price: str = "odds") -> DataFrame:
    """``ev``, ``rec`` (sign) and ``rec_class``; unsafe rows get empty texts."""
    ev = S.expected_value(prob, price)
    safe = (F.coalesce(F.col(price), F.lit(0.0)) <= MAX_PRICE) & (F.col(prob) >= MIN_PROB)

    def pick(index):
        out = F.when(~safe, "")
        for tier in TIERS:
            out = out.when(F.col("ev") >= tier[0], tier[index])
        return out.otherwise("")

    return df.withColumn("ev", ev).withColumns({"rec": pick(1), "rec_class": pick(2)})


def allocate(candidates: DataFrame, budget: float = 10_000.0, *, contest: str = "race_id",
             tiebreak: Sequence[str] = ("horse_num",), prob: str = "prob",
             price: str = "odds", min_ev: float = 1.5, unit: int = 100,
             **skew) -> DataFrame:
    """Best use of a budget per contest, each stake bounded by a quarter of its Kelly share.

    With one budget and a bound per stake, the optimum takes the bets in order of value
    until the budget is spent.  ``stake`` is the exact share, ``amount`` its value in whole
    units; bets rounded to nothing drop out.
    """
    share = F.greatest(S.kelly_fraction(prob, price) * 0.25, F.lit(0.0))
    viable = candidates.withColumn("ev", F.col(prob) * F.col(price)) \
        .where(F.col("ev") > min_ev) \
        .withColumns({"bound": share * budget, "_down": -F.col("ev")})
    o = OrderedRows(viable, [contest], ["_down", *tiebreak], **skew)
    spent = o.finish(o.running({"_spent": F.col("bound")}))
    left = F.lit(float(budget)) - F.coalesce("_spent", F.lit(0.0))
    stake = F.greatest(F.lit(0.0), F.least(F.col("bound"), left))
    amount = (F.bround(stake / unit) * unit).cast("long")
    return spent.withColumn("stake", stake).withColumn("amount", amount) \
        .where(F.col("amount") > 0).drop("_spent", "_down")
