"""The end-to-end query: form of the entrants, relative to their contest, to money."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history import KEY, selected
from checks.registry import query
from checks.tables import ENTRANT_ORDER, R, results
from formline.operators import contest, evaluate, history
from formline.operators.policy import SCENARIOS

ENT = f"PARTITION BY horse_id ORDER BY {ENTRANT_ORDER}"


def money(prob, price):
    parts = []
    for s in SCENARIOS:
        stake = {"fixed_amount": f"CAST({s.amount} AS BIGINT)",
                 "ev_weighted": f"CAST(floor({s.amount} * ({prob} * {price})) AS BIGINT)",
                 "proportional": f"CAST(floor({s.amount} * least(CASE WHEN {price} > 1 THEN"
                                 f" ({prob} * {price} - 1) / ({price} - 1) ELSE 0 END, 0.5))"
                                 f" AS BIGINT)"}[s.method]
        least = 100 if s.method == "proportional" else 1
        parts.append(f"""SELECT '{s.name}' AS scenario, rank, {price} AS price, stake FROM
 (SELECT *, {stake} AS stake FROM scored) WHERE {prob} BETWEEN {s.min_prob} AND {s.max_prob}
 AND {price} BETWEEN {s.min_price} AND {s.max_price} AND {prob} * {price} > {s.min_ev}
 AND stake >= {least}""")
    return " UNION ALL ".join(parts)


@query("form_to_money", f"""WITH {R}, f AS (SELECT race_id, horse_num, rank, odds, pred_prob,
 coalesce(lag(rank) OVER w, 99) AS prev_rank,
 avg(rank) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rank_3_mean,
 avg(rank) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rank_5_mean
 FROM r WINDOW w AS ({ENT})), z AS (SELECT *, (rank_5_mean - avg(rank_5_mean) OVER c)
 / (stddev_samp(rank_5_mean) OVER c + 1e-6) AS z FROM f WINDOW c AS (PARTITION BY race_id)),
 scored AS (SELECT rank, odds, round(pred_prob * CASE WHEN rank_3_mean < prev_rank THEN 1.1
 ELSE 1.0 END * CASE WHEN z < -0.001 THEN 1.5 WHEN z >= -0.001 THEN 0.75 ELSE 1.0 END, 9)
 AS prob FROM z),
 b AS ({money('prob', 'odds')}), t AS (SELECT scenario, sum(stake) AS bet,
 sum(CASE WHEN rank = 1 THEN stake * price ELSE 0 END) AS ret,
 count(*) FILTER (rank = 1) AS hits, count(*) AS n FROM b GROUP BY 1)
 SELECT scenario, CAST(bet AS BIGINT) AS total_bet, CAST(trunc(round(ret, 6)) AS BIGINT) AS total_return,
 CAST(trunc(round(ret - bet, 6)) AS BIGINT) AS profit, round_even(ret / bet * 100, 1) AS recovery_pct,
 round_even(hits / n * 100, 2) AS hit_rate_pct, n AS bets_placed FROM t""")
def form_to_money(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "date_dt", "rank", "odds", "pred_prob")
    o = history.entrant_rows(df, halo=5)
    new = {"prev_rank": history.lags(o)["prev_rank"]}
    new |= history.rolling(o, {"rank": ("mean",)}, (3, 5))
    form = contest.with_relative(selected(o, new, [*KEY, "rank", "odds", "pred_prob"]),
                                 ["rank_5_mean"])
    z = F.col("rank_5_mean_zscore")
    trend = F.when(F.col("rank_3_mean") < F.col("prev_rank"), 1.1).otherwise(1.0)
    better = F.when(z < -0.001, 1.5).when(z >= -0.001, 0.75).otherwise(1.0)
    scored = form.select("rank", "odds", F.round(F.col("pred_prob") * trend * better, 9)
                         .alias("pred_prob"))
    return evaluate.scenario_summary(scored)
