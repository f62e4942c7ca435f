"""Decisions, scenarios, evaluation and score quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history import KEY
from checks.registry import query
from checks.tables import R, results
from formline.functions import scalars as S
from formline.operators import evaluate, joins, policy, profile, tickets
from formline.plans import bundle, daily, training
from formline.plans import features as feat
from formline.plans.state import DayState
from formline.session import own_folder
from formline.skew import OrderedRows

PRED = (*KEY, "pred_prob", "odds", "rank")
SAFE = "odds <= 100 AND pred_prob >= 0.05"


def preds(spark, sf, *more):
    return results(spark, sf, *PRED, *more)


@query("decide_bets", f"""WITH {R} SELECT race_id, horse_num, 'tansho' AS type,
 CAST(100 AS INT) AS amount FROM r WHERE pred_prob * odds > 2.0 AND {SAFE}""")
def decide_bets(spark, sf):
    return policy.decide_bets(preds(spark, sf))


@query("decide_bets_newer_prices", f"""WITH {R} SELECT race_id, horse_num, 'tansho' AS type,
 CAST(100 AS INT) AS amount FROM (SELECT race_id, horse_num, pred_prob, odds * 1.5 AS odds
 FROM r WHERE condition IS NOT NULL) WHERE pred_prob * odds > 2.0 AND {SAFE}""")
def decide_bets_newer_prices(spark, sf):
    prices = results(spark, sf, *KEY, "odds", "condition").where("condition IS NOT NULL")
    return policy.decide_bets(preds(spark, sf), prices.withColumn("odds", F.col("odds") * 1.5))


def scenario_sql(s):
    stake = {"fixed_amount": f"CAST({s.amount} AS BIGINT)",
             "ev_weighted": f"CAST(floor({s.amount} * (pred_prob * odds)) AS BIGINT)",
             "proportional": f"CAST(floor({s.amount} * least(CASE WHEN odds > 1 THEN"
                             f" (pred_prob * odds - 1) / (odds - 1) ELSE 0 END, 0.5)) AS BIGINT)"}
    least = 100 if s.method == "proportional" else 1
    return f"""SELECT * FROM (SELECT race_id, horse_num, rank, odds, '{s.name}' AS scenario,
 {stake[s.method]} AS stake FROM r WHERE pred_prob BETWEEN {s.min_prob} AND {s.max_prob}
 AND odds BETWEEN {s.min_price} AND {s.max_price} AND pred_prob * odds > {s.min_ev})
 WHERE stake >= {least}"""


SCENARIO_BETS = " UNION ALL ".join(scenario_sql(s) for s in policy.SCENARIOS)


@query("scenario_bets", f"""WITH {R} SELECT race_id, horse_num, rank, scenario, stake
 FROM ({SCENARIO_BETS})""")
def scenario_bets(spark, sf):
    return policy.scenario_bets(preds(spark, sf)).drop("odds", "pred_prob")


@query("scenario_summary", f"""WITH {R}, b AS ({SCENARIO_BETS}), t AS (SELECT scenario,
 sum(stake) AS bet, sum(CASE WHEN rank = 1 THEN stake * odds ELSE 0 END) AS ret,
 count(CASE WHEN rank = 1 THEN 1 END) AS hits, count(*) AS n FROM b GROUP BY 1)
 SELECT scenario, CAST(bet AS BIGINT) AS total_bet, CAST(trunc(round(ret, 6)) AS BIGINT) AS total_return,
 CAST(trunc(round(ret - bet, 6)) AS BIGINT) AS profit, round_even(ret / bet * 100, 1) AS recovery_pct,
 round_even(hits / n * 100, 2) AS hit_rate_pct, n AS bets_placed FROM t""")
def scenario_summary(spark, sf):
    return evaluate.scenario_summary(preds(spark, sf))


GRID = ", ".join(f"({t})" for t in evaluate.BASELINE_THRESHOLDS)
GRID_SQL = f"""g AS (SELECT CAST(t AS DOUBLE) AS threshold,
 CAST(count(*) FILTER (pred_prob * odds > t AND {SAFE}) * 100 AS BIGINT) AS bet,
 coalesce(sum(odds * 100) FILTER (pred_prob * odds > t AND {SAFE} AND rank = 1), 0) AS ret
 FROM r, (VALUES {GRID}) v(t) GROUP BY 1),
 h AS (SELECT *, coalesce(ret / nullif(bet, 0) * 100, 0) AS recovery FROM g)"""


@query("threshold_grid", f"WITH {R}, {GRID_SQL} SELECT * FROM h", ["ret", "recovery"])
def threshold_grid(spark, sf):
    return evaluate.threshold_grid(preds(spark, sf), evaluate.BASELINE_THRESHOLDS)


@query("best_threshold", f"""WITH {R}, {GRID_SQL} SELECT threshold, recovery FROM h
 WHERE bet > 0 ORDER BY recovery DESC, threshold LIMIT 1""", ["recovery"])
def best_threshold(spark, sf):
    return evaluate.best_threshold(
        evaluate.threshold_grid(preds(spark, sf), evaluate.BASELINE_THRESHOLDS))


@query("yearly_money", f"""WITH {R}, t AS (SELECT period AS year,
 CAST(grouping(period) AS INT) AS is_total,
 count(*) FILTER (pred_prob * odds > 1.2 AND {SAFE}) * 100 AS filtered_bet,
 coalesce(sum(odds * 100) FILTER (pred_prob * odds > 1.2 AND {SAFE} AND rank = 1), 0)
 AS filtered_ret, count(*) FILTER (pred_prob * odds > 1.2) * 100 AS raw_bet,
 coalesce(sum(odds * 100) FILTER (pred_prob * odds > 1.2 AND rank = 1), 0) AS raw_ret
 FROM r GROUP BY ROLLUP (period)) SELECT *,
 coalesce(filtered_ret / nullif(filtered_bet, 0) * 100, 0) AS filtered_rec,
 coalesce(raw_ret / nullif(raw_bet, 0) * 100, 0) AS raw_rec FROM t""",
       ["filtered_ret", "raw_ret", "filtered_rec", "raw_rec"])
def yearly_money(spark, sf):
    df = preds(spark, sf, "period").withColumnRenamed("period", "year")
    return evaluate.yearly_money(df, 1.2)


def model_sql(name, prob):
    safe = f"{prob} * odds > 2.0 AND odds <= 100 AND {prob} >= 0.05"
    return f"""SELECT '{name}' AS model, period AS year, count(*) FILTER ({safe}) * 100 AS bet,
 coalesce(sum(odds * 100) FILTER ({safe} AND rank = 1), 0) AS ret FROM r GROUP BY 2"""


@query("model_comparison", f"""WITH {R}, t AS ({model_sql('single', 'pred_prob')} UNION ALL
 {model_sql('blend', 'pred_b')}) SELECT *, coalesce(ret / nullif(bet, 0) * 100, 0) AS recovery
 FROM t""", ["ret", "recovery"])
def model_comparison(spark, sf):
    df = preds(spark, sf, "pred_b", "period").withColumnRenamed("period", "year")
    return evaluate.model_comparison(df, {"single": "pred_prob", "blend": "pred_b"})


FIGURES = """count(*) AS bets, count(*) FILTER (rank = 1) AS hits,
 coalesce(sum(odds * 100) FILTER (rank = 1), 0) AS returned,
 count(*) FILTER (rank = 1) / count(*) * 100 AS hit_rate, count(*) * 100 AS invested,
 coalesce(sum(odds * 100) FILTER (rank = 1), 0) / (count(*) * 100) * 100 AS recovery"""
RATES = ["returned", "hit_rate", "recovery"]


@query("key_figures", f"WITH {R} SELECT {FIGURES} FROM r WHERE pred_prob * odds > 3.0", RATES)
def key_figures(spark, sf):
    return evaluate.key_figures(preds(spark, sf).where("pred_prob * odds > 3.0"))


@query("monthly_figures", f"""WITH {R} SELECT strftime(date_dt, '%Y-%m') AS month, {FIGURES}
 FROM r WHERE pred_prob * odds > 1.0 GROUP BY 1""", RATES)
def monthly_figures(spark, sf):
    return evaluate.monthly_figures(
        preds(spark, sf, "date_dt").where("pred_prob * odds > 1.0"))


BAND = "CASE " + " ".join(
    f"WHEN odds >= {a} AND odds < {b} THEN '{n}'" for a, b, n in zip(
        evaluate.PRICE_EDGES, evaluate.PRICE_EDGES[1:], evaluate.PRICE_LABELS, strict=False)
) + " END"


@query("bias_by_price", f"""WITH {R}, q AS (SELECT *, {BAND} AS band FROM r)
 SELECT band, count(*) AS n, avg(pred_prob) AS avg_prob,
 count(*) FILTER (rank = 1) / count(*) AS actual_win, avg(pred_prob * odds) AS avg_ev,
 coalesce(avg(pred_prob) / nullif(count(*) FILTER (rank = 1) / count(*), 0), 0) AS bias
 FROM q WHERE band IS NOT NULL GROUP BY 1""", ["avg_prob", "actual_win", "avg_ev", "bias"])
def bias_by_price(spark, sf):
    return evaluate.bias_by_price(preds(spark, sf))


@query("roi_by_price", f"""WITH {R}, q AS (SELECT *, {BAND} AS band FROM r
 WHERE pred_prob * odds > 1.5) SELECT band, count(*) AS bets,
 count(*) FILTER (rank = 1) AS hits, coalesce(sum(odds) FILTER (rank = 1), 0) AS ret,
 count(*) FILTER (rank = 1) / count(*) AS win_rate,
 coalesce(sum(odds) FILTER (rank = 1), 0) / count(*) * 100 AS roi
 FROM q WHERE band IS NOT NULL GROUP BY 1""", ["ret", "win_rate", "roi"])
def roi_by_price(spark, sf):
    return evaluate.roi_by_price(preds(spark, sf), 1.5)


@query("bets_per_contest", f"""WITH {R} SELECT count(DISTINCT race_id) AS contests,
 count(*) FILTER (pred_prob * odds > 1.5 AND {SAFE}) AS bets,
 count(*) FILTER (pred_prob * odds > 1.5 AND {SAFE}) / count(DISTINCT race_id)
 AS bets_per_contest FROM r""", ["bets_per_contest"])
def bets_per_contest(spark, sf):
    return evaluate.bets_per_contest(preds(spark, sf))


@query("probability_sums", f"""WITH {R}, t AS (SELECT race_id, sum(pred_prob) AS s FROM r
 GROUP BY 1) SELECT avg(s) AS mean, median(s) AS median, min(s) AS min, max(s) AS max FROM t""",
       ["mean", "median", "min", "max"])
def probability_sums(spark, sf):
    return profile.probability_sums(preds(spark, sf))


# --- tickets ----------------------------------------------------------------------

PAIRS = f"""{R}, e AS (SELECT race_id, horse_num, pred_prob, lag(horse_num) OVER c AS h2,
 lag(horse_num, 2) OVER c AS h3, lag(pred_prob) OVER c AS p2, lag(pred_prob, 2) OVER c AS p3
 FROM r WINDOW c AS (PARTITION BY race_id ORDER BY horse_num))"""


def listed_tickets(spark, sf, legs):
    """Every entrant with the one or two entered before it."""
    o = OrderedRows(results(spark, sf, *KEY), ["race_id"], ["horse_num"], halo=legs - 1)
    new = [o.over(F.lag("horse_num", k), o.spec).alias(f"h{k + 1}") for k in range(1, legs)]
    out = o.finish(o.rows.select("*", *new)).withColumnRenamed("horse_num", "h1")
    return out.where(F.col(f"h{legs}").isNotNull())


def exacta(a, b):
    return f"{a} * ({b} / (1.0 - {a} + 1e-9))"


def trifecta(a, b, c):
    return f"{exacta(a, b)} * ({c} / (1.0 - {a} - {b} + 1e-9))"


@query("tickets_two_places", f"""WITH {PAIRS} SELECT race_id, horse_num AS h1, h2,
 {exacta('pred_prob', 'p2')} AS exacta,
 {exacta('pred_prob', 'p2')} + {exacta('p2', 'pred_prob')} AS quinella
 FROM e WHERE h2 IS NOT NULL""", ["exacta", "quinella"])
def tickets_two_places(spark, sf):
    return tickets.with_ticket_probabilities(
        listed_tickets(spark, sf, 2), results(spark, sf, *KEY, "pred_prob"))


ABC = ("pred_prob", "p2", "p3")
TRIO = " + ".join(trifecta(*(ABC[i] for i in o)) for o in (
    (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))


@query("tickets_three_places", f"""WITH {PAIRS} SELECT race_id, horse_num AS h1, h2, h3,
 {trifecta(*ABC)} AS trifecta, {TRIO} AS trio FROM e WHERE h3 IS NOT NULL""",
       ["trifecta", "trio"])
def tickets_three_places(spark, sf):
    return tickets.with_ticket_probabilities(
        listed_tickets(spark, sf, 3), results(spark, sf, *KEY, "pred_prob"),
        legs=("h1", "h2", "h3"))


@query("tickets_by_set", f"""WITH {PAIRS} SELECT race_id, least(horse_num, h2) AS low,
 greatest(horse_num, h2) AS high,
 {exacta('pred_prob', 'p2')} + {exacta('p2', 'pred_prob')} AS exacta
 FROM e WHERE h2 IS NOT NULL""", ["exacta"])
def tickets_by_set(spark, sf):
    """Both orders listed; summed per set they give the unordered probability."""
    one = listed_tickets(spark, sf, 2)
    both = one.unionByName(one.select("race_id", F.col("h2").alias("h1"), F.col("h1").alias("h2")))
    scored = tickets.with_ticket_probabilities(both, results(spark, sf, *KEY, "pred_prob"))
    out = tickets.combined_by_set(scored)
    return out.select("race_id", F.col("combo")[0].alias("low"), F.col("combo")[1].alias("high"),
                      "exacta")


# --- allocation -------------------------------------------------------------------

ALLOCATE = f"""WITH {R}, c AS (SELECT race_id, horse_num, pred_prob * odds AS ev,
 greatest(CASE WHEN odds > 1 THEN (pred_prob * odds - 1) / (odds - 1) ELSE 0 END * 0.25, 0)
 * 1000.0 AS bound FROM r WHERE pred_prob * odds > 1.5), s AS (SELECT *,
 coalesce(sum(bound) OVER (PARTITION BY race_id ORDER BY ev DESC, horse_num
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c),
 x AS (SELECT race_id, horse_num, greatest(0, least(bound, 1000.0 - spent)) AS stake FROM s)
 SELECT race_id, horse_num, stake, CAST(round_even(stake / 100, 0) * 100 AS BIGINT) AS amount
 FROM x WHERE round_even(stake / 100, 0) > 0"""


def allocated(spark, sf, **skew):
    df = results(spark, sf, *KEY, "pred_prob", "odds").withColumnRenamed("pred_prob", "prob")
    return policy.allocate(df, 1000.0, **skew).select(*KEY, "stake", "amount")


@query("allocation", ALLOCATE, ["stake"])
def allocation(spark, sf):
    return allocated(spark, sf)


@query("allocation_sliced", ALLOCATE, ["stake"])
def allocation_sliced(spark, sf):
    """Allocation on the path for hot contests."""
    return allocated(spark, sf, hot_rows=4, slice_rows=2)


# --- daily ------------------------------------------------------------------------

COURSE = "CASE substr(race_id, 5, 2) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.CENTRAL_COURSES.items()) + " ELSE '不明' END"
TITLE = (f"{COURSE} || CAST(CAST(substr(race_id, 7, 2) AS INT) AS STRING) || '回' || "
         "CAST(CAST(substr(race_id, 9, 2) AS INT) AS STRING) || '日 第' || "
         "CAST(CAST(substr(race_id, 11, 2) AS INT) AS STRING) || 'R'")


def tier_sql(i):
    return ("CASE WHEN odds > 100 OR pred_prob < 0.05 THEN '' "
            + " ".join(f"WHEN pred_prob * odds >= {t[0]} THEN '{t[i]}'" for t in policy.TIERS)
            + " ELSE '' END")


REC = f"""{R}, rec AS (SELECT race_id, {TITLE} AS race_title, horse_num, horse_name,
 pred_prob AS prob, odds, pred_prob * odds AS ev, {tier_sql(1)} AS rec, {tier_sql(2)}
 AS rec_class, CAST(row_number() OVER (PARTITION BY race_id ORDER BY pred_prob DESC, horse_num)
 AS INT) AS display_order FROM r)"""


def recs(spark, sf):
    return daily.recommendations(results(spark, sf, *KEY, "horse_name", "pred_prob", "odds"))


@query("recommendations", f"WITH {REC} SELECT * FROM rec", ["prob", "odds", "ev"])
def recommendations(spark, sf):
    return recs(spark, sf)


SETTLED = f"""{REC}, o AS (SELECT race_id, min(horse_num) AS win_horse_num,
 CAST(round_even(min(odds) * 100, 0) AS INT) AS win_payout FROM r
 WHERE rank = 1 AND substr(race_id, 11, 2) <> '05' GROUP BY 1),
 st AS (SELECT rec.race_id, rec.horse_num, CASE WHEN o.race_id IS NULL THEN 'SKIP'
 WHEN rec.horse_num = o.win_horse_num THEN 'WIN' ELSE 'LOSE' END AS status,
 CASE WHEN rec.horse_num = o.win_horse_num THEN win_payout ELSE 0 END AS returned
 FROM rec LEFT JOIN o ON rec.race_id = o.race_id WHERE rec_class IN ('buy', 'strong-buy'))"""


def outcomes(spark, sf):
    """One winner per contest; contests with number 05 have no result yet."""
    df = results(spark, sf, *KEY, "odds", "rank").where(
        (F.col("rank") == 1) & (F.substring("race_id", 11, 2) != "05"))
    return df.groupBy("race_id").agg(
        F.min("horse_num").alias("win_horse_num"),
        F.bround(F.min("odds") * 100).cast("int").alias("win_payout"))


@query("settled_bets", f"WITH {SETTLED} SELECT * FROM st")
def settled_bets(spark, sf):
    settled, _ = daily.settlement(recs(spark, sf), outcomes(spark, sf))
    return settled.select("race_id", "horse_num", "status", "returned")


@query("settlement_summary", f"""WITH {SETTLED}, t AS (SELECT
 count(*) FILTER (status <> 'SKIP') AS bets, count(*) FILTER (status = 'WIN') AS hits,
 count(*) FILTER (status <> 'SKIP') * 100 AS cost,
 CAST(coalesce(sum(returned) FILTER (status <> 'SKIP'), 0) AS BIGINT) AS returned FROM st)
 SELECT *, returned - cost AS profit, coalesce(hits / nullif(bets, 0) * 100, 0) AS hit_rate,
 coalesce(returned / nullif(cost, 0) * 100, 0) AS recovery FROM t""", ["hit_rate", "recovery"])
def settlement_summary(spark, sf):
    return daily.settlement(recs(spark, sf), outcomes(spark, sf))[1]


TODAY = "CAST(date_dt AS DATE) = DATE '2024-01-30'"


@query("daily_scoring", f"""WITH {R}, k AS (SELECT * FROM r WHERE NOT ({TODAY})
 OR substr(race_id, 5, 2) <= '10'), h AS (SELECT *, coalesce(lag(CASE WHEN {TODAY} THEN NULL
 ELSE rank END) OVER (PARTITION BY horse_id ORDER BY date_dt, race_id, horse_num), 99)
 AS prev_rank FROM k), d AS (SELECT *, 1 / (1.0 + prev_rank) AS prob FROM h WHERE {TODAY})
 SELECT race_id, horse_num, prob, odds, prob * odds AS ev,
 {tier_sql(1).replace('pred_prob', 'prob')} AS rec, CAST(row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, horse_num) AS INT)
 AS display_order FROM d""", ["prob", "odds", "ev"])
def daily_scoring(spark, sf):
    """The whole daily pipeline: state after the past, the day's features from it, table."""
    df = results(spark, sf).drop("event_id", "day", "period", "pred_prob", "pred_b")
    day = F.col("date_dt").cast("date") == F.lit("2024-01-30").cast("date")
    entries = df.where(day).drop("rank", "prize", "agari_3f", "passing_order", "time", "margin")

    def score(wide):
        return wide.withColumn("pred_prob", 1 / (1.0 + F.col("prev_rank")))

    # The means of the rates play no role for this score.
    before = DayState.of(df.where(F.col("date_dt").cast("date") < F.lit("2024-01-30")))
    scored = daily.score_day(before, entries, "2024-01-30", score, means={})
    return daily.recommendations(scored).select(
        "race_id", F.col("horse_num").cast("int").alias("horse_num"), "prob", "odds", "ev",
        "rec", "display_order")


# A saved model on a saved state scores the day as the model in memory does over the whole past.
@query("daily_state_scores", f"""WITH {R} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different,
 CAST(0 AS BIGINT) AS outside, true AS varied FROM r
 WHERE {TODAY} AND substr(race_id, 5, 2) <= '10'""")
def daily_state_scores(spark, sf):
    df = results(spark, sf).drop("event_id", "day", "pred_prob", "pred_b")
    date = F.col("date_dt").cast("date")
    past = df.where(date < F.lit("2024-01-30"))
    entries = df.where(date == F.lit("2024-01-30")).drop(
        "rank", "prize", "agari_3f", "passing_order", "time", "margin")
    wide = feat.build_features(past)
    # Every feature is compared in the tests; the model reads some of each family.
    known = feat.model_columns(wide, ["period"])
    rows, target, classes = training.fitted_encoders(wide.select(*dict.fromkeys([
        *KEY, "target", "jockey_id", "trainer_id", "weather", *known[::12]])), "target")
    model = training.fit_calibrated(rows, feat.model_columns(rows), "target", maxIter=3,
                                    maxDepth=3, folds=2)
    final = bundle.ScoringBundle(model, target, classes, feat.rate_means(wide))
    folder = own_folder(spark, "daily")
    final.save(spark, f"{folder}/bundle")
    DayState.of(past).save(spark, f"{folder}/state")
    one = daily.score_day(past, entries, "2024-01-30", final, only_relevant=False)
    two = daily.score_day(DayState.load(spark, f"{folder}/state"), entries, "2024-01-30",
                          bundle.ScoringBundle.load(spark, f"{folder}/bundle"))
    p, q = F.col("p"), F.col("q")
    return one.select(*KEY, F.col("pred_prob").alias("p")).join(
        two.select(*KEY, F.col("pred_prob").alias("q")), list(KEY), "full").agg(
        F.count("*").alias("n"),
        F.count_if(~(F.abs(p - q) < 1e-9) | p.isNull() | q.isNull()).alias("different"),
        F.count_if(~q.between(0, 1)).alias("outside"),
        (F.count_distinct("q") > 1).alias("varied"))


# Fills and rates of the day are the same from the narrowed past as from the whole past.
@query("daily_fills", f"""WITH {R} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM r
 WHERE {TODAY} AND substr(race_id, 5, 2) <= '10'""")
def daily_fills(spark, sf):
    df = results(spark, sf).drop("event_id", "day", "period", "pred_prob", "pred_b")
    day = F.col("date_dt").cast("date") == F.lit("2024-01-30").cast("date")
    past = df.where(~day)
    entries = df.where(day).drop("rank", "prize", "agari_3f", "passing_order", "time", "margin")
    means = feat.means_of(past)
    rates = [c for c in feat.RATE_COLUMNS if c in means]

    def rows(name, only_relevant):
        scored = daily.score_day(past, entries, "2024-01-30", lambda w: w, means=means,
                                 only_relevant=only_relevant)
        return scored.select(*KEY, F.struct(*[F.round(c, 9).alias(c) for c in rates]).alias(name))
    both = rows("narrow", True).join(rows("whole", False), list(KEY))
    return both.agg(F.count("*").alias("n"),
                    F.count_if(~F.col("narrow").eqNullSafe(F.col("whole"))).alias("different"))


@query("bets_with_results", f"""WITH {R} SELECT race_id, horse_num, CAST(100 AS INT) AS amount,
 rank, CASE WHEN rank = 1 THEN 100 * odds ELSE 0 END AS payout FROM r
 WHERE pred_prob * odds > 2.0 AND {SAFE}""", ["payout"])
def bets_with_results(spark, sf):
    """Bets joined to the separate result rows by contest and entry, first match only."""
    bets = policy.decide_bets(preds(spark, sf)).drop("type")
    found = results(spark, sf, *KEY, "rank", "odds", "event_id")
    out = joins.with_exact_match(bets, found, {k: k for k in KEY}, ["rank", "odds"], ["event_id"])
    return out.select(*KEY, "amount", "rank", F.when(
        F.col("rank") == 1, F.col("amount") * F.col("odds")).otherwise(0.0).alias("payout"))


# --- score quality ----------------------------------------------------------------

T = f"{R}, t AS (SELECT *, CASE WHEN rank = 1 THEN 1 ELSE 0 END AS target FROM r)"
LOSS = "-CASE WHEN target = 1 THEN ln({p}) ELSE ln(1 - {p}) END"


def scored(spark, sf, *more):
    return results(spark, sf, *KEY, "rank", "pred_prob", *more).withColumn(
        "target", S.is_winner("rank"))


@query("score_quality", f"""WITH {T} SELECT count(*) AS n,
 avg(CASE WHEN (pred_prob > 0.5) = (target = 1) THEN 1 ELSE 0 END) AS accuracy,
 avg({LOSS.format(p='pred_prob')}) AS logloss FROM t""", ["accuracy", "logloss"])
def score_quality(spark, sf):
    return evaluate.score_quality(scored(spark, sf))


@query("roc_auc", f"""WITH {T}, c AS (SELECT pred_prob, sum(target) AS pos,
 count(*) - sum(target) AS neg FROM t GROUP BY 1), b AS (SELECT *,
 coalesce(sum(neg) OVER (ORDER BY pred_prob ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0) AS below FROM c)
 SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b""", ["auc"])
def roc_auc(spark, sf):
    return evaluate.roc_auc(scored(spark, sf), piece_rows=50)


EDGES = [k * 0.1 for k in range(1, 10)]


def bin_sql(sign: str) -> str:
    return "CAST(" + " + ".join(f"(pred_prob {sign} {e!r})::INT" for e in EDGES) + " AS INT)"


# Scores on the edges of the bins are planted: means take the upper edge in, counts the lower.
@query("calibration_table", f"""WITH {T}, e AS (SELECT pred_prob, target FROM t
 UNION ALL SELECT x, CAST(y AS INT) FROM (VALUES {", ".join(
     f"(CAST({e!r} AS DOUBLE), {k % 2})" for k, e in enumerate([0.0, *EDGES, 1.0]))}) v(x, y)),
 m AS (SELECT {bin_sql(">")} AS bin, avg(pred_prob) AS mean_pred, avg(target) AS fraction_pos
 FROM e WHERE pred_prob IS NOT NULL GROUP BY 1),
 n AS (SELECT {bin_sql(">=")} AS bin, count(*) AS n FROM e WHERE pred_prob IS NOT NULL GROUP BY 1)
 SELECT bin, mean_pred, fraction_pos, coalesce(n, 0) AS n FROM m FULL JOIN n USING (bin)""",
       ["mean_pred", "fraction_pos"])
def calibration_table(spark, sf):
    df = scored(spark, sf).select("pred_prob", F.col("target").cast("int").alias("target"))
    on_edges = spark.createDataFrame([(float(e), k % 2) for k, e in enumerate(
        [0.0, *EDGES, 1.0])], "pred_prob double, target int")
    return evaluate.calibration_table(df.unionByName(on_edges))


WEIGHTS = ", ".join(f"({w})" for w in evaluate.BLEND_WEIGHTS)
MIX = "(pred_prob * w + pred_b * (1 - w))"
BLEND = f"""{T}, b AS (SELECT CAST(w AS DOUBLE) AS weight, avg({LOSS.format(p=MIX)}) AS logloss
 FROM t, (SELECT CAST(x AS DOUBLE) AS w FROM (VALUES {WEIGHTS}) v(x)) GROUP BY 1)"""


@query("blend_search", f"WITH {BLEND} SELECT * FROM b", ["logloss"])
def blend_search(spark, sf):
    return evaluate.blend_search(scored(spark, sf, "pred_b"), "pred_prob", "pred_b")


@query("best_blend_weight",
       f"WITH {BLEND} SELECT * FROM b ORDER BY logloss, weight LIMIT 1", ["logloss"])
def best_blend_weight(spark, sf):
    return evaluate.best_weight(
        evaluate.blend_search(scored(spark, sf, "pred_b"), "pred_prob", "pred_b"))


@query("blend_and_class", f"""WITH {R}, q AS (SELECT race_id, horse_num,
 pred_prob * 0.4 + pred_b * (1 - 0.4) AS blend FROM r)
 SELECT *, CASE WHEN blend > 0.5 THEN 1 ELSE 0 END AS class FROM q""", ["blend"])
def blend_and_class(spark, sf):
    df = results(spark, sf, *KEY, "pred_prob", "pred_b")
    mixed = df.select(*KEY, evaluate.blend("pred_prob", "pred_b", 0.4).alias("blend"))
    return mixed.withColumn("class", (F.col("blend") > 0.5).cast("int"))
