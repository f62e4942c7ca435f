"""Evaluation of decisions and scores as distributed aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators.policy import (
    DEFAULT_EV,
    SCENARIOS,
    STAKE,
    Scenario,
    safe_bet,
    scenario_fits,
    scenario_stake,
)
from formline.session import park
from formline.skew import global_running

# Fixed values.
PRICE_EDGES = (1, 2, 5, 10, 20, 50, 100, 1000)
PRICE_LABELS = ("1-2", "2-5", "5-10", "10-20", "20-50", "50-100", "100+")
THRESHOLDS = tuple(round(x * 0.1, 1) for x in range(10, 21))
BASELINE_THRESHOLDS = tuple(round(x * 0.1, 1) for x in range(10, 31))
BLEND_WEIGHTS = tuple(round(x * 0.05, 2) for x in range(21))
LOG_FLOOR = 2.220446049250313e-16  # smallest distance of a probability from 0 and 1


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def won(position: str = "rank") -> Column:
    return F.col(position) == 1


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def total_of(value: Column, condition: Column) -> Column:
    """Sum over the rows that meet the condition, 0 without any."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def whole(amount: Column) -> Column:
    """Amount cut to whole units; a millionth is settled first, so that the order in which
    tasks summed plays no role."""
    return F.round(amount, 6).cast("long")


# --- money ------------------------------------------------------------------------

def scenario_summary(preds: DataFrame, scenarios: Sequence[Scenario] = SCENARIOS, *,
                     prob: str = "pred_prob", price: str = "odds") -> DataFrame:
    """Per scenario: bet, return, profit, recovery %, hit rate %, bets (0 if never used).

    The scenarios are constants, so each is a handful of conditional sums of one generated
    aggregation: one pass, no row is copied, one partial row per task is shuffled.
    """
    p, o = F.col(prob), F.col(price)
    sums = []
    for i, s in enumerate(scenarios):
        stake = F.when(scenario_fits(s, p, o), scenario_stake(s.method, s.amount, p, o))
        bet = F.when(stake > 0, stake)
        sums += [F.sum(bet).alias(f"bet_{i}"), count_of(bet.isNotNull()).alias(f"n_{i}"),
                 F.sum(F.when(won(), bet * o)).alias(f"ret_{i}"),
                 count_of(bet.isNotNull() & won()).alias(f"hits_{i}")]
    per = F.array(*[F.struct(
        F.lit(s.name).alias("scenario"),
        F.coalesce(f"bet_{i}", F.lit(0)).cast("long").alias("bet"),
        F.coalesce(f"ret_{i}", F.lit(0.0)).alias("ret"),
        F.col(f"hits_{i}").alias("hits"), F.col(f"n_{i}").alias("n"))
        for i, s in enumerate(scenarios)])
    rows = preds.agg(*sums).select(F.explode(per).alias("_r")).select("_r.*")
    return rows.select(
        "scenario", F.col("bet").alias("total_bet"),
        whole(F.col("ret")).alias("total_return"),
        whole(F.col("ret") - F.col("bet")).alias("profit"),
        F.bround(percent(F.col("ret"), F.col("bet")), 1).alias("recovery_pct"),
        F.bround(percent(F.col("hits"), F.col("n")), 2).alias("hit_rate_pct"),
        F.col("n").alias("bets_placed"))


def yearly_money(preds: DataFrame, min_ev: float = DEFAULT_EV, *, year: str = "year",
                 prob: str = "pred_prob", price: str = "odds") -> DataFrame:
    """Per year and in total (year NULL, is_total 1): raw and safety-filtered bets."""
    p, o = F.col(prob), F.col(price)
    raw, safe = p * o > min_ev, safe_bet(p, o, min_ev)
    payout = o * STAKE
    sums = preds.rollup(year).agg(
        F.grouping(year).cast("int").alias("is_total"),
        (count_of(safe) * STAKE).alias("filtered_bet"),
        total_of(payout, safe & won()).alias("filtered_ret"),
        (count_of(raw) * STAKE).alias("raw_bet"),
        total_of(payout, raw & won()).alias("raw_ret"))
    return sums.select(
        year, "is_total", "filtered_bet", "filtered_ret",
        percent(F.col("filtered_ret"), F.col("filtered_bet")).alias("filtered_rec"),
        "raw_bet", "raw_ret", percent(F.col("raw_ret"), F.col("raw_bet")).alias("raw_rec"))


def threshold_grid(preds: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *,
                   prob: str = "pred_prob", price: str = "odds",
                   by: Sequence[str] = ()) -> DataFrame:
    """Per threshold: bet, return and recovery of the safety-filtered bets.

    Two conditional sums per threshold in one aggregation; no row is copied.
    """
    p, o = F.col(prob), F.col(price)
    sums = []
    for i, t in enumerate(thresholds):
        chosen = safe_bet(p, o, t)
        sums += [(count_of(chosen) * STAKE).alias(f"bet_{i}"),
                 total_of(o * STAKE, chosen & won()).alias(f"ret_{i}")]
    per = F.array(*[F.struct(F.lit(float(t)).alias("threshold"),
                             F.col(f"bet_{i}").alias("bet"), F.col(f"ret_{i}").alias("ret"))
                    for i, t in enumerate(thresholds)])
    rows = preds.groupBy(*by).agg(*sums).select(*by, F.explode(per).alias("_r"))
    return rows.select(*by, "_r.*").withColumn(
        "recovery", percent(F.col("ret"), F.col("bet")))


def best_threshold(grid: DataFrame) -> DataFrame:
    """Highest recovery among thresholds with bets; the lowest threshold wins ties."""
    return grid.where((F.col("bet") > 0) & (F.col("recovery") > 0)).agg(
        F.max_by(F.struct("threshold", "recovery"),
                 F.struct("recovery", -F.col("threshold"))).alias("best")
    ).select(F.coalesce("best.threshold", F.lit(0.0)).alias("threshold"),
             F.coalesce("best.recovery", F.lit(0.0)).alias("recovery"))


def model_comparison(preds: DataFrame, models: dict[str, str], *, year: str = "year",
                     price: str = "odds", min_ev: float = DEFAULT_EV) -> DataFrame:
    """Per model (name -> probability column) and year: bet, return, recovery."""
    o = F.col(price)
    scored = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("prob"))
                       for m, c in models.items()])
    rows = preds.select(year, price, "rank", F.explode(scored).alias("_m")) \
        .select(year, price, "rank", "_m.model", "_m.prob")
    safe = safe_bet("prob", price, min_ev)
    sums = rows.groupBy("model", year).agg(
        (count_of(safe) * STAKE).alias("bet"), total_of(o * STAKE, safe & won()).alias("ret"))
    return sums.withColumn("recovery", percent(F.col("ret"), F.col("bet")))


def key_figures(bets: DataFrame, by: Sequence[str | Column] = (), price: str = "odds",
                position: str = "rank") -> DataFrame:
    """Bets, hits, hit rate, invested, returned, recovery; in all or per group."""
    sums = bets.groupBy(*by).agg(
        F.count("*").alias("bets"), count_of(won(position)).alias("hits"),
        total_of(F.col(price) * STAKE, won(position)).alias("returned"))
    return sums.withColumns({
        "hit_rate": percent(F.col("hits"), F.col("bets")),
        "invested": F.col("bets") * STAKE,
        "recovery": percent(F.col("returned"), F.col("bets") * STAKE)})


def monthly_figures(bets: DataFrame, date: str = "date_dt") -> DataFrame:
    return key_figures(bets, [S.month_text(date).alias("month")])


def daily_summary(settled: DataFrame) -> DataFrame:
    """Totals of the settled bets; rows still open do not count."""
    done = F.col("status") != "SKIP"
    sums = settled.agg(
        count_of(done).alias("bets"), count_of(F.col("status") == "WIN").alias("hits"),
        (count_of(done) * STAKE).alias("cost"),
        F.coalesce(F.sum(F.when(done, F.col("returned"))), F.lit(0)).alias("returned"))
    return sums.withColumns({
        "profit": F.col("returned") - F.col("cost"),
        "hit_rate": percent(F.col("hits"), F.col("bets")),
        "recovery": percent(F.col("returned"), F.col("cost"))})


def price_band(price: str = "odds") -> Column:
    return S.left_closed_bin(price, PRICE_EDGES, PRICE_LABELS)


def bias_by_price(preds: DataFrame, prob: str = "pred_prob", price: str = "odds") -> DataFrame:
    """Per price band: mean probability against actual win rate."""
    rows = preds.withColumn("band", price_band(price)).where(F.col("band").isNotNull())
    sums = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.avg(prob).alias("avg_prob"),
        (count_of(won()) / F.count("*")).alias("actual_win"),
        F.avg(F.col(prob) * F.col(price)).alias("avg_ev"))
    bias = F.coalesce(F.try_divide("avg_prob", "actual_win"), F.lit(0.0))
    return sums.withColumn("bias", bias)


def roi_by_price(preds: DataFrame, min_ev: float = DEFAULT_EV, prob: str = "pred_prob",
                 price: str = "odds") -> DataFrame:
    bets = preds.where(F.col(prob) * F.col(price) > min_ev) \
        .withColumn("band", price_band(price)).where(F.col("band").isNotNull())
    sums = bets.groupBy("band").agg(
        F.count("*").alias("bets"), count_of(won()).alias("hits"),
        total_of(F.col(price), won()).alias("ret"))
    return sums.withColumns({"win_rate": F.col("hits") / F.col("bets"),
                             "roi": percent(F.col("ret"), F.col("bets"))})


def bets_per_contest(preds: DataFrame, min_ev: float = 1.5, contest: str = "race_id",
                     prob: str = "pred_prob", price: str = "odds") -> DataFrame:
    """Contests, bets and bets per contest; two aggregation levels, no distinct set."""
    per = preds.groupBy(contest).agg(count_of(safe_bet(prob, price, min_ev)).alias("b"))
    return per.agg(F.count(contest).alias("contests"), F.sum("b").alias("bets")).withColumn(
        "bets_per_contest", F.try_divide("bets", "contests"))


# --- score quality ----------------------------------------------------------------

def clipped(prob: Column) -> Column:
    return F.greatest(F.least(prob, F.lit(1 - LOG_FLOOR)), F.lit(LOG_FLOOR))


def log_loss(label: Column, prob: Column) -> Column:
    p = clipped(prob)
    return F.avg(-F.when(label == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def score_quality(df: DataFrame, label: str = "target", prob: str = "pred_prob") -> DataFrame:
    """Rows, accuracy at 0.5 and log loss."""
    y, p = F.col(label), F.col(prob)
    hit = ((p > 0.5).cast("int") == y).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"),
                  log_loss(y, p).alias("logloss"))


def roc_auc(df: DataFrame, label: str = "target", prob: str = "pred_prob",
            **pieces) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are reduced to counts per score; the running count of negatives below each score
    is taken per score range plus the range totals, so no task sorts all scores.
    """
    y = F.col(label)
    counts = park(df.groupBy(F.col(prob).alias("score")).agg(
        count_of(y == 1).alias("pos"), count_of(y == 0).alias("neg")), "scores")
    ranked = global_running(counts, ["score"], {"below": F.col("neg")}, **pieces)
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum(F.col("pos")).cast("double") * F.sum(F.col("neg"))
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))


def calibration_table(df: DataFrame, label: str = "target", prob: str = "pred_prob",
                      bins: int = 10) -> DataFrame:
    """Uniform probability bins: mean score, fraction of positives, rows; no empty bins.

    Means are over bins that hold their upper edge (the first holds 0, too), the count ``n`` is
    over bins that hold their lower edge (the last holds 1, too).  A bin without means but with
    a count, or the other way round, is kept.  NULL scores are left out.
    """
    p = F.col(prob)
    edges = [k * (1 / bins) for k in range(1, bins)]
    upper = sum((F.when(p > e, 1).otherwise(0) for e in edges), F.lit(0))
    lower = sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))
    sides = df.where(p.isNotNull()).select(
        p.alias("_p"), F.col(label).cast("double").alias("_y"), F.explode(F.array(
            F.struct(upper.alias("bin"), F.lit(True).alias("mean")),
            F.struct(lower.alias("bin"), F.lit(False).alias("mean")))).alias("_s"))
    mean = F.col("_s.mean")
    return sides.groupBy(F.col("_s.bin").alias("bin")).agg(
        F.avg(F.when(mean, F.col("_p"))).alias("mean_pred"),
        F.avg(F.when(mean, F.col("_y"))).alias("fraction_pos"),
        F.count(F.when(~mean, 1)).alias("n"))


def blend(first: str | Column, second: str | Column, weight: float | Column) -> Column:
    return S.col(first) * weight + S.col(second) * (F.lit(1.0) - weight)


def blend_search(df: DataFrame, first: str, second: str, label: str = "target",
                 weights: Sequence[float] = BLEND_WEIGHTS) -> DataFrame:
    """Log loss per blend weight, all weights in one aggregation without extra rows."""
    y = F.col(label)
    losses = df.agg(*[log_loss(y, blend(first, second, F.lit(float(w)))).alias(f"_{i}")
                      for i, w in enumerate(weights)])
    pairs = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"_{i}").alias("logloss"))
                      for i, w in enumerate(weights)])
    return losses.select(F.explode(pairs).alias("_p")).select("_p.*")


def best_weight(search: DataFrame) -> DataFrame:
    """Lowest log loss; the lowest weight wins ties."""
    return search.agg(F.min_by(F.struct("weight", "logloss"), F.struct("logloss", "weight"))
                      .alias("best")).select("best.*")
