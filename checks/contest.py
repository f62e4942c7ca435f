"""Contest-relative columns and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history import KEY, P, ewma_sql
from checks.registry import query
from checks.tables import ENTRANT_ORDER, R, results
from formline.functions import scalars as S
from formline.operators import contest, encoders, history
from formline.plans import features as feat

CON = "PARTITION BY race_id"


def relative_sql(c):
    m, d = f"avg({c}) OVER ({CON})", f"stddev_samp({c}) OVER ({CON})"
    lo, hi = f"min({c}) OVER ({CON})", f"max({c}) OVER ({CON})"
    return f"""{m} AS {c}_race_mean, {d} AS {c}_race_std, {lo} AS {c}_race_min,
 {hi} AS {c}_race_max, {c} - {m} AS {c}_diff_race_mean,
 ({c} - {m}) / ({d} + 1e-6) AS {c}_zscore, {c} / ({m} + 1e-6) AS {c}_ratio_race_mean,
 {c} - {lo} AS {c}_diff_race_min, {c} - {hi} AS {c}_diff_race_max"""


def relative_names(columns):
    parts = ("race_mean", "race_std", "race_min", "race_max", "diff_race_mean", "zscore",
             "ratio_race_mean", "diff_race_min", "diff_race_max")
    return [f"{c}_{p}" for c in columns for p in parts]


BASE = ("horse_weight", "age", "weight")
RELATIVE_SQL = f"""WITH {R} SELECT race_id, horse_num,
 {', '.join(relative_sql(c) for c in BASE)} FROM r"""


def relative(spark, sf, **skew):
    df = results(spark, sf, *KEY, *BASE)
    return contest.with_relative(df, BASE, **skew).select(*KEY, *relative_names(BASE))


@query("contest_relative", RELATIVE_SQL, relative_names(BASE))
def contest_relative(spark, sf):
    return relative(spark, sf)


@query("contest_relative_hot", RELATIVE_SQL, relative_names(BASE))
def contest_relative_hot(spark, sf):
    """The same on the path for hot contests."""
    return relative(spark, sf, hot_rows=14)


FORM = ("prev_rank", "interval", "rank_5_mean")


@query("contest_relative_form", f"""WITH {R}, f AS (SELECT race_id, horse_num,
 coalesce(lag(rank) OVER w, 99) AS prev_rank,
 coalesce(date_diff('day', CAST(lag(date_dt) OVER w AS DATE), CAST(date_dt AS DATE)), 0)
 AS interval, avg(rank) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rank_5_mean
 FROM r WINDOW w AS (PARTITION BY horse_id ORDER BY {ENTRANT_ORDER}))
 SELECT race_id, horse_num, {', '.join(relative_sql(c) for c in FORM)} FROM f""",
       relative_names(FORM))
def contest_relative_form(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "date_dt", "rank")
    o = history.entrant_rows(df, halo=5)
    new = {"prev_rank": history.lags(o)["prev_rank"], "interval": history.day_gap(o)}
    new |= history.rolling(o, {"rank": ("mean",)}, (5,))
    wide = o.finish(o.rows.select("*", *[c.alias(n) for n, c in new.items()]))
    return contest.with_relative(wide, FORM).select(*KEY, *relative_names(FORM))


PACE = [f"race_{a}_{s}_{b}" for s in contest.PACE_STYLES
        for a, b in (("expected", "count"), ("max", "prob"))] + ["race_pace_index"]


def rate5(s):
    return (f"coalesce(avg(CASE WHEN running_style = '{s}' THEN 1 ELSE 0 END) OVER "
            f"(PARTITION BY horse_id ORDER BY {ENTRANT_ORDER}"
            f" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS rate_{s}")


@query("contest_pace", f"""WITH {P}, t AS (SELECT race_id, horse_num,
 {', '.join(rate5(s) for s in contest.PACE_STYLES)} FROM s) SELECT race_id, horse_num, """
       + ", ".join(f"coalesce(sum(rate_{s}) OVER c, 0) AS race_expected_{s}_count,"
                   f" max(rate_{s}) OVER c AS race_max_{s}_prob"
                   for s in contest.PACE_STYLES)
       + """, coalesce(sum(rate_Nigeru) OVER c, 0) * 1.5 + coalesce(sum(rate_Senko) OVER c, 0)
 AS race_pace_index FROM t WINDOW c AS (PARTITION BY race_id)""", PACE)
def contest_pace(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "date_dt", "passing_order")
    df = df.withColumn("running_style", S.running_style("passing_order"))
    o = history.entrant_rows(df, halo=5)
    rates = history.category_rates(o, windows=(5,))
    wide = o.finish(o.rows.select("*", *[c.alias(n) for n, c in rates.items()]))
    return contest.with_pace(wide).select(*KEY, *PACE)


ZSCORES = {"horse_weight": "weight_zscore", "age": "age_zscore", "odds": "odds_zscore"}


def zscore_sql(c, n):
    x = f"coalesce({c}, 0)"
    return (f"coalesce(({x} - avg({x}) OVER ({CON})) / (stddev_samp({x}) OVER ({CON}) + 1e-6),"
            f" 0) AS {n}")


@query("contest_zscores", f"""WITH {R} SELECT race_id, horse_num,
 {', '.join(zscore_sql(c, n) for c, n in ZSCORES.items())} FROM r""", list(ZSCORES.values()))
def contest_zscores(spark, sf):
    df = results(spark, sf, *KEY, *ZSCORES)
    return contest.with_zscores(df, ZSCORES).select(*KEY, *ZSCORES.values())


SECONDS = ("CAST(split_part(time, ':', 1) AS DOUBLE) * 60"
           " + CAST(split_part(time, ':', 2) AS DOUBLE)")


@query("contest_dead_even_target", f"""WITH {R}, q AS (SELECT *, {SECONDS} AS t FROM r),
 w AS (SELECT *, min(CASE WHEN rank = 1 THEN t END) OVER ({CON}) AS best FROM q)
 SELECT race_id, horse_num, CASE WHEN rank = 1 OR (rank = 2 AND t = best) THEN 1 ELSE 0 END
 AS target FROM w""")
def contest_dead_even_target(spark, sf):
    df = results(spark, sf, *KEY, "rank", "time").withColumn(
        "time_seconds", S.clock_seconds("time"))
    return contest.with_dead_even_target(df).select(*KEY, "target")


ORDER_SQL = f"""WITH {R} SELECT race_id, horse_num, CAST(row_number() OVER ({CON}
 ORDER BY pred_prob DESC, horse_num) AS INT) AS display_order FROM r"""


@query("contest_display_order", ORDER_SQL)
def contest_display_order(spark, sf):
    df = results(spark, sf, *KEY, "pred_prob")
    return contest.with_display_order(df).select(*KEY, "display_order")


@query("contest_display_order_sliced", ORDER_SQL)
def contest_display_order_sliced(spark, sf):
    """Display order on the path for hot contests."""
    df = results(spark, sf, *KEY, "pred_prob")
    return contest.with_display_order(df, hot_rows=12, slice_rows=5).select(
        *KEY, "display_order")


@query("contest_normalised_probability", f"""WITH {R} SELECT race_id, horse_num, pred_prob
 / sum(pred_prob) OVER ({CON}) AS norm_prob FROM r""", ["norm_prob"])
def contest_normalised_probability(spark, sf):
    df = results(spark, sf, *KEY, "pred_prob")
    return contest.with_normalised_probability(df).select(*KEY, "norm_prob")


@query("contest_coverage_filter", f"""WITH {R}, q AS (SELECT *, count(*) OVER ({CON}) AS n,
 avg(CASE WHEN condition IS NULL THEN 0 ELSE 1 END) OVER ({CON}) AS known FROM r)
 SELECT race_id, horse_num, CAST(n AS BIGINT) AS n_horses FROM q WHERE known >= 0.75""")
def contest_coverage_filter(spark, sf):
    df = contest.with_field_size(results(spark, sf, *KEY, "condition"))
    return contest.well_covered_contests(df, "condition", 0.75).select(*KEY, "n_horses")


# --- encoders ---------------------------------------------------------------------

I = f"""{R}, i AS (SELECT *, CASE WHEN rank = 1 THEN 1 ELSE 0 END AS target,
 substr(race_id, 5, 2) AS place,
 CASE WHEN distance < 1400 THEN 'Sprint' WHEN distance < 1800 THEN 'Mile'
 WHEN distance < 2200 THEN 'Intermediate' ELSE 'Long' END AS distance_category,
 coalesce(jockey_id, 'nan') || '_' || trainer_id AS jockey_trainer_pair,
 coalesce(jockey_id, 'unknown') AS jockey_u FROM r),
 k AS (SELECT * REPLACE (jockey_u AS jockey_id), jockey_u || '_' || place AS jockey_place,
 jockey_u || '_' || surface AS jockey_surface,
 jockey_u || '_' || distance_category AS jockey_distance,
 trainer_id || '_' || place AS trainer_place,
 trainer_id || '_' || surface AS trainer_surface,
 trainer_id || '_' || distance_category AS trainer_distance,
 owner_id || '_' || surface AS owner_surface, horse_id || '_' || jockey_u AS horse_jockey,
 sire_id || '_' || surface AS sire_surface,
 sire_id || '_' || distance_category AS sire_distance,
 bms_id || '_' || surface AS bms_surface,
 bms_id || '_' || distance_category AS bms_distance,
 CAST(age AS STRING) || '_' || gender AS age_gender,
 race_class || '_' || distance_category AS class_distance,
 coalesce(condition, 'nan') || '_' || surface AS condition_surface FROM i)"""


def with_keys(spark, sf):
    return feat.with_interactions(
        feat.with_unknown_filled(feat.with_basic_columns(results(spark, sf))))


@query("interaction_keys", f"""WITH {I} SELECT race_id, horse_num,
 {', '.join(encoders.TARGET_KEYS)} FROM k""")
def interaction_keys(spark, sf):
    return with_keys(spark, sf).select(*KEY, *encoders.TARGET_KEYS)


ENCODED = [f"{c}_target_enc" for c in encoders.TARGET_KEYS]


GLOBAL_SQL = f"""WITH {I}, m AS (SELECT avg(target) AS g FROM k WHERE period < 2023), """ + \
    ", ".join(f"""e_{c} AS (SELECT {c} AS key, (sum(target) + (SELECT g FROM m) * 10)
 / (count(*) + 10) AS enc FROM k WHERE period < 2023 AND {c} IS NOT NULL GROUP BY 1)"""
              for c in encoders.TARGET_KEYS) + \
    " SELECT a.race_id, a.horse_num, " + ", ".join(
        f"coalesce(e_{c}.enc, m.g) AS {c}_target_enc" for c in encoders.TARGET_KEYS) + \
    " FROM k a, m " + " ".join(
        f"LEFT JOIN e_{c} ON a.{c} = e_{c}.key" for c in encoders.TARGET_KEYS)


@query("target_encoding", GLOBAL_SQL, ENCODED, 12)
def target_encoding(spark, sf):
    df = with_keys(spark, sf)
    fitted = encoders.fit_target_encoder(df.where("period < 2023"), encoders.TARGET_KEYS)
    return fitted.transform(df.select(*KEY, *encoders.TARGET_KEYS)).select(*KEY, *ENCODED)


FOLD_SQL = f"""WITH {I}, f AS (SELECT *, CAST(event_id % 5 AS INT) AS fold FROM k),
 m AS (SELECT o.fold, sum(CASE WHEN f.fold <> o.fold THEN f.target END) * 1.0
 / count(CASE WHEN f.fold <> o.fold THEN 1 END) AS g
 FROM f, (SELECT unnest(range(5)) AS fold) o GROUP BY 1), """ + ", ".join(
    f"""t_{c} AS (SELECT {c} AS key, sum(target) AS s, count(*) AS n FROM f
 WHERE {c} IS NOT NULL GROUP BY 1), o_{c} AS (SELECT {c} AS key, fold, sum(target) AS s,
 count(*) AS n FROM f WHERE {c} IS NOT NULL GROUP BY 1, 2)""" for c in encoders.TARGET_KEYS) + \
    " SELECT a.race_id, a.horse_num, " + ", ".join(
    f"CASE WHEN t_{c}.n > o_{c}.n THEN (t_{c}.s - o_{c}.s + m.g * 10)"
    f" / (t_{c}.n - o_{c}.n + 10) ELSE m.g END AS {c}_target_enc"
    for c in encoders.TARGET_KEYS) + " FROM f a JOIN m ON a.fold = m.fold " + " ".join(
    f"LEFT JOIN t_{c} ON a.{c} = t_{c}.key LEFT JOIN o_{c} ON a.{c} = o_{c}.key"
    f" AND a.fold = o_{c}.fold" for c in encoders.TARGET_KEYS)


@query("target_encoding_out_of_fold", FOLD_SQL, ENCODED, 12)
def target_encoding_out_of_fold(spark, sf):
    df = with_keys(spark, sf).withColumn("fold", encoders.fold_of("event_id"))
    slim = df.select(*KEY, "fold", "target", *encoders.TARGET_KEYS)
    return encoders.with_out_of_fold_encoding(slim, encoders.TARGET_KEYS).select(*KEY, *ENCODED)


LABELS = ("weather", "condition", "gender", "surface", "race_class", "margin", "horse_name")
LABEL_SQL = f"WITH {R}, " + ", ".join(
    f"""l_{c} AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS code FROM
 (SELECT DISTINCT coalesce({c}, 'nan') AS key FROM r WHERE period < 2022))"""
    for c in LABELS) + " SELECT race_id, horse_num, " + ", ".join(
    f"CAST(coalesce(l_{c}.code, -1) AS INT) AS {c}" for c in LABELS) + " FROM r " + " ".join(
    f"LEFT JOIN l_{c} ON coalesce(r.{c}, 'nan') = l_{c}.key" for c in LABELS)


@query("label_encoding", LABEL_SQL)
def label_encoding(spark, sf):
    df = results(spark, sf, *KEY, "period", *LABELS)
    fitted = encoders.fit_label_encoder(df.where("period < 2022"), LABELS)
    return fitted.transform(df.drop("period"))


# --- pipeline ---------------------------------------------------------------------

FILLED = ("jockey_win_rate_100", "popularity", "impost_ratio", "weight_change_ratio",
          "prev_rank")


@query("feature_fills", f"""WITH {R}, q AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL
 ELSE CAST(rank AS DOUBLE) / 12 END AS rate, CASE WHEN event_id % 6 = 0 THEN NULL ELSE rank END
 AS pr FROM r) SELECT race_id, horse_num,
 coalesce(rate, (SELECT avg(rate) FROM q)) AS jockey_win_rate_100,
 CAST(coalesce(popularity, 99) AS DOUBLE) AS popularity,
 weight / nullif(horse_weight, 0) AS impost_ratio,
 weight_change / nullif(horse_weight, 0) AS weight_change_ratio,
 CAST(coalesce(pr, 0) AS DOUBLE) AS prev_rank FROM q""", FILLED)
def feature_fills(spark, sf):
    df = results(spark, sf, *KEY, "event_id", "rank", "popularity", "weight", "weight_change",
                 "horse_weight")
    df = df.withColumns({
        "jockey_win_rate_100": F.when(F.col("event_id") % 4 != 0, F.col("rank") / 12),
        "prev_rank": F.when(F.col("event_id") % 6 != 0, F.col("rank"))})
    return feat.filled(feat.with_ratios(df)).select(
        F.col("race_id"), F.col("horse_num").cast("int").alias("horse_num"), *FILLED)


@query("feature_alignment", f"""WITH {R} SELECT race_id, horse_num,
 CAST(coalesce(popularity, -999) AS DOUBLE) AS popularity,
 CAST(coalesce(agari_3f, -999) AS DOUBLE) AS agari_3f,
 CAST(-999 AS DOUBLE) AS not_there FROM r""", ["agari_3f"])
def feature_alignment(spark, sf):
    df = results(spark, sf, *KEY, "popularity", "agari_3f")
    return feat.aligned(df, ["popularity", "agari_3f", "not_there"])


@query("course_and_year_filters", f"""WITH {R} SELECT race_id, horse_num, period FROM r
 WHERE substr(race_id, 5, 2) <= '10' AND period >= 2021 AND period < 2024""")
def course_and_year_filters(spark, sf):
    df = feat.central_only(results(spark, sf, *KEY, "period"))
    return feat.between_years(df, 2021, 2024, "period")


@query("date_slice", f"""WITH {R} SELECT race_id, horse_num FROM r
 WHERE CAST(date_dt AS DATE) = DATE '2024-01-15'""")
def date_slice(spark, sf):
    df = results(spark, sf, *KEY, "date_dt")
    return feat.on_date(df, "2024-01-15").select(*KEY)


# The numeric columns of the contest table that are known before a contest.
KNOWN = ("age", "distance", "horse_num", "horse_weight", "weight", "weight_change")


@query("model_columns", f"WITH {R} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, sum(CAST({c} AS DOUBLE)) AS total FROM r"
    for c in KNOWN), ["total"])
def model_columns(spark, sf):
    """Count and sum of every column a model may learn from."""
    df = results(spark, sf)
    names = feat.model_columns(df, ["event_id", "day", "period", "pred_prob", "pred_b"])
    sums = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("p"))
    return sums.groupBy("p.name").agg(F.count("p.v").alias("n"), F.sum("p.v").alias("total"))


@query("build_features", f"""WITH {P} SELECT race_id, horse_num,
 CAST(coalesce(lag(rank) OVER w, 99) AS DOUBLE) AS prev_rank,
 coalesce(avg(CASE WHEN running_style = 'Senko' THEN 1 ELSE 0 END)
 OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS "rate_Senko_10"
 FROM s WINDOW w AS (PARTITION BY horse_id ORDER BY {ENTRANT_ORDER})""",
       ["prev_rank", "rate_Senko_10"])
def build_features(spark, sf):
    """The whole pipeline; two of its columns are compared."""
    wide = feat.build_features(results(spark, sf))
    return wide.select("race_id", F.col("horse_num").cast("int").alias("horse_num"),
                       "prev_rank", "rate_Senko_10")


BASE_Z = ["weight_zscore", "age_zscore", "odds_zscore", "ewma_prize_zscore"]
QUOTED = {"horse_weight": "weight_zscore", "age": "age_zscore", "odds": "odds_zscore",
          "ewma_prize_5": "ewma_prize_zscore"}


@query("baseline_features", f"""WITH {R}, q AS (SELECT *, {SECONDS} AS t, row_number() OVER
 (PARTITION BY horse_id ORDER BY {ENTRANT_ORDER}) AS rn FROM r),
 e AS (SELECT *, {ewma_sql('prize', 'ewma_prize_5', 0)},
 min(CASE WHEN rank = 1 THEN t END) OVER ({CON}) AS best FROM q)
 SELECT race_id, horse_num, CASE WHEN rank = 1 OR (rank = 2 AND t = best) THEN 1 ELSE 0 END
 AS target, {', '.join(zscore_sql(c, n) for c, n in QUOTED.items())} FROM e""", BASE_Z)
def baseline_features(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "jockey_id", "trainer_id", "date_dt", "rank",
                 "prize", "odds", "surface", "weight_change", "time", "horse_weight", "age")
    return feat.build_baseline_features(df).select(*KEY, "target", *BASE_Z)
