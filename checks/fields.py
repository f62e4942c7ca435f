"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history import KEY
from checks.money import COURSE, TITLE
from checks.registry import query
from checks.tables import R, V, results, table, vendor
from formline.functions import scalars as S

ALL_COURSES = {**S.CENTRAL_COURSES, **S.LOCAL_COURSES}
REPORT = "coalesce(CASE substr(race_id, 5, 2) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ALL_COURSES.items()) + \
    " END, '不明(' || substr(race_id, 5, 2) || ')')"


@query("contest_ids", f"""WITH {R} SELECT race_id, horse_num, substr(race_id, 1, 4) AS year,
 substr(race_id, 5, 2) AS course_code, CAST(substr(race_id, 7, 2) AS INT) AS kai,
 CAST(substr(race_id, 9, 2) AS INT) AS day, CAST(substr(race_id, 11, 2) AS INT) AS race_num,
 {COURSE} AS course_name, {TITLE} AS title,
 {REPORT} || ' 第' || CAST(CAST(substr(race_id, 11, 2) AS INT) AS STRING) || 'R' AS report
 FROM r""")
def contest_ids(spark, sf):
    df = results(spark, sf, *KEY)
    return df.select(*KEY, S.contest_parts("race_id").alias("p"),
                     S.contest_title("race_id").alias("title"),
                     S.report_title("race_id").alias("report")).select(
        *KEY, "p.*", "title", "report")


@query("canonical_ids", """SELECT event_id, CAST(user_id AS STRING) AS from_float,
 CAST(user_id AS STRING) AS from_text FROM events""")
def canonical_ids(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id",
                     S.canonical_id(F.col("user_id").cast("decimal(12,1)")).alias("from_float"),
                     S.canonical_id(F.col("user_id").cast("string")).alias("from_text"))


@query("dates", f"""WITH {R}, q AS (SELECT *, CASE event_id % 3 WHEN 0 THEN date
 WHEN 1 THEN strftime(date_dt, '%Y-%m-%d') ELSE 'unknown' END AS mixed FROM r)
 SELECT race_id, horse_num, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(date_dt AS DATE) END
 AS d, CASE event_id % 3 WHEN 0 THEN CAST(date_dt AS DATE) END AS strict_d,
 strftime(date_dt, '%Y-%m') AS month FROM q""")
def dates(spark, sf):
    df = results(spark, sf, *KEY, "event_id", "date", "date_dt")
    iso = F.date_format("date_dt", "yyyy-MM-dd")
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("date")).when(
        F.col("event_id") % 3 == 1, iso).otherwise("unknown")
    return df.withColumn("mixed", mixed).select(
        *KEY, S.event_date("mixed").cast("date").alias("d"),
        S.strict_japanese_date("mixed").cast("date").alias("strict_d"),
        S.month_text("date_dt").alias("month"))


CODES = "CASE 場所 " + " ".join(f"WHEN '{v}' THEN '{k}'"
                              for k, v in S.CENTRAL_COURSES.items()) + " END"
STYLES = "CAST(CASE 脚質 " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.STYLE_CODES.items()) \
    + " ELSE 0 END AS INT)"


@query("vendor_fields", f"""WITH {V} SELECT event_id, make_date(CASE WHEN 年 < 50 THEN 2000 + 年
 ELSE 1900 + 年 END, 月, 日) AS date_jv, {CODES} AS place, {STYLES} AS style,
 TRY_CAST(PCI AS DOUBLE) AS pci FROM v""")
def vendor_fields(spark, sf):
    return vendor(spark, sf).select(
        "event_id", S.vendor_date("年", "月", "日").alias("date_jv"),
        S.course_code_of_name("場所").alias("place"), S.style_code("脚質").alias("style"),
        S.number("PCI").alias("pci"))


WORDS = "CASE margin " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.MARGIN_WORDS.items()) \
    + " WHEN '1/2' THEN 0.5 WHEN '1 1/4' THEN 1.25 WHEN '3' THEN 3 END"


@query("text_fields", f"""WITH {R}, q AS (SELECT *,
 CAST(split_part(passing_order, '-', 1) AS INT) AS a,
 CAST(split_part(passing_order, '-', -1) AS INT) AS b FROM r)
 SELECT race_id, horse_num, CAST(split_part(time, ':', 1) AS DOUBLE) * 60
 + CAST(split_part(time, ':', 2) AS DOUBLE) AS seconds, CAST({WORDS} AS DOUBLE) AS margin,
 a AS first_pos, b AS final_pos, b - a AS gain, CASE WHEN b = 1 THEN 'Nigeru'
 WHEN b <= 4 THEN 'Senko' WHEN b <= 9 THEN 'Sashi' ELSE 'Oikomi' END AS style FROM q""")
def text_fields(spark, sf):
    df = results(spark, sf, *KEY, "time", "margin", "passing_order")
    first, final = S.first_position("passing_order"), S.final_position("passing_order")
    return df.select(*KEY, S.clock_seconds("time").alias("seconds"),
                     S.margin_lengths("margin").alias("margin"), first.alias("first_pos"),
                     final.alias("final_pos"), (final - first).alias("gain"),
                     S.running_style("passing_order").alias("style"))


@query("categories", f"""WITH {R} SELECT race_id, horse_num,
 CASE WHEN distance < 1400 THEN 'Sprint' WHEN distance < 1800 THEN 'Mile'
 WHEN distance < 2200 THEN 'Intermediate' ELSE 'Long' END AS distance_category,
 CASE WHEN horse_weight IS NULL THEN 'Unknown' WHEN horse_weight < 440 THEN 'Light'
 WHEN horse_weight < 480 THEN 'Medium' WHEN horse_weight < 520 THEN 'Heavy'
 ELSE 'SuperHeavy' END AS weight_bin FROM r""")
def categories(spark, sf):
    df = results(spark, sf, *KEY, "distance", "horse_weight")
    return df.select(*KEY, S.distance_category("distance").alias("distance_category"),
                     S.weight_bin("horse_weight").alias("weight_bin"))


@query("value_fields", f"""WITH {R}, q AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL
 ELSE odds END AS price FROM r)
 SELECT race_id, horse_num, ln(1 + prize) AS log_prize, ln(1 + coalesce(price, 0)) AS log_odds,
 CASE WHEN rank = 1 THEN 1 ELSE 0 END AS target, CASE WHEN rank <= 2 THEN 1 ELSE 0 END AS placed,
 CASE WHEN rank <= 3 THEN 1 ELSE 0 END AS shown, coalesce(pred_prob * price, 0) AS ev,
 CASE WHEN price > 1 THEN (pred_prob * price - 1) / (price - 1) ELSE 0 END AS kelly FROM q""",
       ["log_prize", "log_odds", "ev", "kelly"])
def value_fields(spark, sf):
    df = results(spark, sf, *KEY, "event_id", "rank", "odds", "prize", "pred_prob")
    df = df.withColumn("price", F.when(F.col("event_id") % 5 != 0, F.col("odds")))
    return df.select(
        *KEY, S.log1p0("prize").alias("log_prize"), S.log1p0("price").alias("log_odds"),
        S.is_winner("rank").alias("target"), S.within("rank", 2).alias("placed"),
        S.within("rank", 3).alias("shown"), S.expected_value("pred_prob", "price").alias("ev"),
        S.kelly_fraction("pred_prob", "price").alias("kelly"))
