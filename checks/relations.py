"""Joins, profiles, set operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history import KEY, VENDOR_SQL
from checks.registry import query
from checks.tables import R, V, results, table, vendor
from formline.functions import scalars as S
from formline.operators import joins, profile
from formline.plans import features as feat
from formline.plans import reconcile, training
from formline.sources import tables as src

# --- joins ------------------------------------------------------------------------


@query("dimension_join", """SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, c_name,
 c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def dimension_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    dim = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.with_dimension(orders, dim, "o_custkey", ("o_custkey", "c_name", "c_mktsegment"))


PED = ["sire_name", "owner_name"]


@query("pedigree_join", f"""WITH {R}, h AS (SELECT CAST(c_custkey + 2015100000 AS STRING)
 AS horse_id, c_name AS sire_name, c_mktsegment AS owner_name FROM customer)
 SELECT race_id, horse_num, r.horse_id, sire_name, owner_name FROM r
 LEFT JOIN h ON r.horse_id = h.horse_id""")
def pedigree_join(spark, sf):
    """Float-looking dimension ids meet text ids."""
    dim = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 2015100000).cast("decimal(12,1)").cast("string").alias("horse_id"),
        F.col("c_name").alias("sire_name"), F.col("c_mktsegment").alias("owner_name"))
    return joins.with_dimension(results(spark, sf, *KEY, "horse_id"), dim).select(
        *KEY, "horse_id", *PED)


VF = f"""{R}, {VENDOR_SQL}, f AS (SELECT *, TRY_CAST(PCI AS DOUBLE) AS pci,
 lpad(CAST("レース番号" AS STRING), 2, '0') AS no, CASE 場所 {' '.join(
     f"WHEN '{v}' THEN '{k}'" for k, v in S.CENTRAL_COURSES.items())} END AS place FROM vd)"""
EXACT = """x AS (SELECT horse_id_jv, date_jv, place, no, min_by("RPCI", event_id) AS rpci
 FROM f GROUP BY 1, 2, 3, 4)"""
COARSE = """y AS (SELECT horse_id_jv, year(date_jv) AS y, place, no,
 min_by("RPCI", (date_jv, event_id)) AS rpci FROM f GROUP BY 1, 2, 3, 4)"""
ON_X = """r.horse_id = x.horse_id_jv AND CAST(date_dt AS DATE) = x.date_jv
 AND substr(race_id, 5, 2) = x.place AND substr(race_id, 11, 2) = x.no"""
ON_Y = """r.horse_id = y.horse_id_jv AND year(date_dt) = y.y
 AND substr(race_id, 5, 2) = y.place AND substr(race_id, 11, 2) = y.no"""
SAME = {"horse_id": "horse_id_jv", "_place": "place_code_jv", "_no": "レース番号"}
EXACT_KEYS, COARSE_KEYS = {**SAME, "_day": "date_jv"}, {**SAME, "_year": "_year_jv"}


def both_sources(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "date_dt").withColumns({
        "_place": S.place_code("race_id"), "_day": F.col("date_dt").cast("date"),
        "_no": F.substring("race_id", 11, 2).cast("int"), "_year": F.year("date_dt")})
    other = src.vendor_table(vendor(spark, sf)).withColumns({
        "_year_jv": F.year("date_jv"), "rpci": F.col("RPCI").cast("int").cast("string")})
    return df, other


@query("four_key_join", f"""WITH {VF}, {EXACT} SELECT race_id, horse_num, x.rpci FROM r
 LEFT JOIN x ON {ON_X}""")
def four_key_join(spark, sf):
    df, other = both_sources(spark, sf)
    return joins.with_exact_match(df, other, EXACT_KEYS, ["rpci"], ["event_id"]).select(
        *KEY, "rpci")


@query("two_tier_join", f"""WITH {VF}, {EXACT}, {COARSE} SELECT race_id, horse_num,
 coalesce(x.rpci, y.rpci) AS rpci, CASE WHEN x.rpci IS NOT NULL THEN 'exact'
 WHEN y.rpci IS NOT NULL THEN 'coarse' ELSE 'none' END AS match_tier
 FROM r LEFT JOIN x ON {ON_X} LEFT JOIN y ON {ON_Y}""")
def two_tier_join(spark, sf):
    df, other = both_sources(spark, sf)
    return joins.with_two_tier_match(df, other, EXACT_KEYS, COARSE_KEYS, ["rpci"],
                                     ["date_jv", "event_id"]).select(*KEY, "rpci", "match_tier")


@query("adaptive_join", f"""WITH {VF}, {COARSE} SELECT race_id, horse_num, y.rpci FROM r
 LEFT JOIN y ON {ON_Y}""")
def adaptive_join(spark, sf):
    """Too few rows match exactly for the asked 99.9 %, so the coarse keys are taken."""
    df, other = both_sources(spark, sf)
    return joins.with_adaptive_match(df, other, EXACT_KEYS, COARSE_KEYS, ["rpci"],
                                     ["date_jv", "event_id"], "rpci", 0.999).select(*KEY, "rpci")


@query("match_rates", f"""WITH {VF}, {EXACT}, {COARSE}, z AS (SELECT horse_id_jv,
 min_by("RPCI", event_id) AS rpci FROM f GROUP BY 1), m AS (
 SELECT 'date' AS key_set, x.rpci FROM r LEFT JOIN x ON {ON_X}
 UNION ALL SELECT 'year', y.rpci FROM r LEFT JOIN y ON {ON_Y}
 UNION ALL SELECT 'id', z.rpci FROM r LEFT JOIN z ON r.horse_id = z.horse_id_jv)
 SELECT key_set, count(*) AS rows, count(rpci) AS matched, count(rpci) / count(*) AS match_rate
 FROM m GROUP BY 1""", ["match_rate"])
def match_rates(spark, sf):
    df, other = both_sources(spark, sf)
    return reconcile.match_rates(df, other, {
        "date": EXACT_KEYS, "year": COARSE_KEYS, "id": {"horse_id": "horse_id_jv"}},
        "rpci", ["event_id"])


@query("latest_known", f"""WITH {R} SELECT horse_id,
 max_by(popularity, (date_dt, event_id)) FILTER (popularity IS NOT NULL) AS popularity,
 max_by(condition, (date_dt, event_id)) FILTER (condition IS NOT NULL) AS condition,
 max_by(odds, (date_dt, event_id)) AS odds FROM r GROUP BY 1""")
def latest_known(spark, sf):
    df = results(spark, sf, "horse_id", "date_dt", "event_id", "popularity", "condition", "odds")
    return joins.latest_known(df, ["horse_id"], ["date_dt", "event_id"],
                              ["popularity", "condition", "odds"])


@query("first_row_join", f"""WITH {R}, f AS (SELECT l_suppkey, l_orderkey, l_quantity
 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey
 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) = 1)
 SELECT s_suppkey, s_name, l_orderkey, l_quantity FROM supplier
 LEFT JOIN f ON s_suppkey = l_suppkey""")
def first_row_join(spark, sf):
    lines = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    values = ["l_orderkey", "l_quantity"]
    return joins.with_exact_match(
        table(spark, sf, "supplier").select("s_suppkey", "s_name"), lines,
        {"s_suppkey": "l_suppkey"}, values, order)


@query("known_keys_only", """SELECT o_orderkey FROM orders WHERE EXISTS
 (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def known_keys_only(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.rows_with_known_key(
        table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("relevant_history", f"""WITH {R}, today AS (SELECT DISTINCT horse_id FROM r
 WHERE CAST(date_dt AS DATE) = DATE '2024-01-30'),
 j AS (SELECT DISTINCT jockey_id FROM r
 WHERE CAST(date_dt AS DATE) = DATE '2024-01-30')
 SELECT race_id, horse_num FROM r WHERE CAST(date_dt AS DATE) < DATE '2024-01-30'
 AND (horse_id IN (FROM today) OR jockey_id IN (FROM j))""")
def relevant_history(spark, sf):
    df = results(spark, sf, *KEY, "horse_id", "jockey_id", "date_dt")
    today = feat.on_date(df, "2024-01-30")
    past = df.where(F.col("date_dt").cast("date") < F.lit("2024-01-30").cast("date"))
    return feat.relevant_history(past, today, ["horse_id", "jockey_id"]).select(*KEY)


# --- profiles ---------------------------------------------------------------------

PROFILE = """CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS n,
 avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS win_rate, avg(odds) AS mean_price,
 avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) * avg(odds) * 100 AS simple_recovery"""
VR = f"""{V}, q AS (SELECT *, CAST("確定着順" AS INT) AS rank, "単勝オッズ" AS odds FROM v)"""
FLOATS = ["win_rate", "mean_price", "simple_recovery"]


def vendor_results(spark, sf):
    return vendor(spark, sf).withColumns({
        "rank": F.col("確定着順").cast("int"), "odds": F.col("単勝オッズ")})


def add_profile(key, column):
    @query(f"profile_by_{key}", f"""WITH {VR} SELECT "{column}" AS key, {PROFILE} FROM q
 WHERE rank > 0 AND "{column}" IS NOT NULL GROUP BY 1""", FLOATS, 8)
    def run(spark, sf):
        df = profile.valid_positions(vendor_results(spark, sf))
        return profile.rate_profile(df, F.col(f"`{column}`"), "key")


for _key, _column in {"popularity": "人気", "style": "脚質", "blinkers": "ブリンカー",
                      "mark": "馬印1", "sire_type": "父タイプ", "bms_type": "母父タイプ"}.items():
    add_profile(_key, _column)


def bin_sql(column, edges, labels):
    x = f'TRY_CAST("{column}" AS DOUBLE)'
    return "CASE " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(
        edges, labels, strict=False)) + f" WHEN {x} IS NOT NULL THEN '{labels[-1]}' END"


def add_bins(key, column):
    edges, labels = profile.BINS[column]

    @query(f"profile_by_{key}", f"""WITH {VR}, b AS (SELECT *, {bin_sql(column, edges, labels)}
 AS bin FROM q) SELECT bin, {PROFILE} FROM b WHERE bin IS NOT NULL GROUP BY 1""", FLOATS, 8)
    def run(spark, sf):
        df = profile.valid_positions(vendor_results(spark, sf))
        binned = S.right_closed_bin(S.number(F.col(f"`{column}`")), edges, labels)
        return profile.rate_profile(df, binned, "bin")


for _key, _column in {"pace_figure": "PCI", "speed_figure": "補正タイム", "weight_delta": "増減",
                      "closing_difference": "-3F差"}.items():
    add_bins(_key, _column)


@query("top_profiles", f"""WITH {VR}, t AS (SELECT "馬印1" AS key, {PROFILE} FROM q
 WHERE "馬印1" IS NOT NULL GROUP BY 1) SELECT * FROM t ORDER BY win_rate DESC, key LIMIT 2""",
       FLOATS, 8)
def top_profiles(spark, sf):
    rates = profile.rate_profile(vendor_results(spark, sf), "馬印1", "key")
    return profile.top_by(rates, [F.desc("win_rate"), F.asc("key")], 2)


ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                 "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
                 "o_orderpriority": "string"}


@query("column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) / count(*) * 100 AS missing_pct,
 count(DISTINCT {c}) AS distinct_values, '{k}' AS kind FROM orders"""
    for c, k in ORDER_COLUMNS.items()), ["missing_pct"])
def column_profile(spark, sf):
    return profile.column_profile(table(spark, sf, "orders"))


@query("column_profile_with_missing", f"WITH {R} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) / count(*) * 100 AS missing_pct,
 count(DISTINCT {c}) AS distinct_values FROM r"""
    for c in ("jockey_id", "popularity", "condition", "margin")), ["missing_pct"])
def column_profile_with_missing(spark, sf):
    df = results(spark, sf, "jockey_id", "popularity", "condition", "margin")
    return profile.column_profile(df).drop("kind")


NUMERIC = ("odds", "horse_weight", "popularity", "agari_3f")


@query("numeric_summary", f"WITH {R} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg({c}) AS mean, stddev_samp({c}) AS std,
 avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing FROM r""" for c in NUMERIC),
       ["mean", "std", "missing"])
def numeric_summary(spark, sf):
    return profile.numeric_summary(results(spark, sf, *NUMERIC), NUMERIC)


@query("top_values", f"""WITH {R} SELECT horse_id AS value, count(*) AS rows FROM r GROUP BY 1
 ORDER BY rows DESC, value LIMIT 5""")
def top_values(spark, sf):
    return profile.top_values(results(spark, sf, "horse_id"), "horse_id")


@query("correlations", f"""WITH {R}, c AS ({' UNION ALL '.join(
    f'''SELECT '{c}' AS "column", count({c}) AS known, corr(rank, {c}) AS with_rank,
 corr(CASE WHEN rank = 1 THEN 1 ELSE 0 END, {c}) AS with_win FROM r''' for c in NUMERIC)})
 SELECT * FROM c WHERE known > 100""", ["with_rank", "with_win"])
def correlations(spark, sf):
    return profile.correlations(results(spark, sf, "rank", *NUMERIC), NUMERIC, minimum=100)


@query("numeric_quality", f"""WITH {V} SELECT count(*) AS n,
 count(*) FILTER (TRY_CAST(PCI AS DOUBLE) IS NULL) AS missing,
 count(*) FILTER (TRY_CAST(PCI AS DOUBLE) = 0) AS zeros,
 count(*) FILTER (PCI IS NOT NULL AND TRY_CAST(PCI AS DOUBLE) IS NULL) AS unreadable FROM v""")
def numeric_quality(spark, sf):
    return profile.numeric_quality(vendor(spark, sf), "PCI")


DATES = """d AS (SELECT 1 AS source, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL
 SELECT 2, CAST(l_shipdate AS DATE) FROM lineitem),
 b AS (SELECT greatest(min(d) FILTER (source = 1), min(d) FILTER (source = 2)) AS lo,
 least(max(d) FILTER (source = 1), max(d) FILTER (source = 2)) AS hi FROM d)"""


@query("date_overlap", f"""WITH {DATES} SELECT source, lo AS overlap_start, hi AS overlap_end,
 min(d) AS first_date, max(d) AS last_date, count(*) AS n,
 count(*) FILTER (d BETWEEN lo AND hi) AS n_inside,
 count(*) FILTER (d BETWEEN lo AND hi) / count(*) * 100 AS share_inside
 FROM d, b GROUP BY 1, 2, 3""", ["share_inside"])
def date_overlap(spark, sf):
    return profile.date_overlap(table(spark, sf, "orders"), table(spark, sf, "lineitem"),
                                "o_orderdate", "l_shipdate")


@query("length_distribution", """SELECT CAST(length(p_name) AS INT) AS length, count(*) AS rows
 FROM part GROUP BY 1""")
def length_distribution(spark, sf):
    return profile.length_distribution(table(spark, sf, "part"), "p_name")


@query("key_overlap", """SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS first_keys,
 (SELECT count(DISTINCT user_id) FROM events) AS second_keys,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events))
 AS common_keys, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT
 SELECT user_id FROM events)) / (SELECT count(DISTINCT o_custkey) FROM orders) * 100
 AS match_rate""", ["match_rate"])
def key_overlap(spark, sf):
    return profile.key_overlap(table(spark, sf, "orders"), table(spark, sf, "events"),
                               "o_custkey", "user_id")


@query("common_keys", """SELECT CAST(o_custkey AS STRING) AS key FROM orders INTERSECT
 SELECT CAST(user_id AS STRING) FROM events""")
def common_keys(spark, sf):
    return profile.common_keys(table(spark, sf, "orders"), table(spark, sf, "events"),
                               "o_custkey", "user_id")


@query("exact_median", "SELECT median(l_extendedprice) AS median FROM lineitem", ["median"], 4)
def exact_median(spark, sf):
    return profile.exact_median(table(spark, sf, "lineitem"), "l_extendedprice")


# --- order, split, sets -----------------------------------------------------------

CUT = """n AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS m FROM lineitem GROUP BY 1),
 u AS (SELECT d, sum(m) OVER (ORDER BY d) AS upto, sum(m) OVER () AS total FROM n)"""


@query("ordered_split", f"""WITH {CUT}, c AS (SELECT min(d) AS cut FROM u
 WHERE upto >= total * 0.8) SELECT cut, count(*) FILTER (CAST(l_shipdate AS DATE) <= cut)
 AS train_rows, count(*) FILTER (CAST(l_shipdate AS DATE) > cut) AS test_rows
 FROM lineitem, c GROUP BY 1""")
def ordered_split(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate")
    cut = profile.ordered_cut(lines, "l_shipdate").first()["cut"]
    day = F.col("l_shipdate").cast("date")
    return lines.agg(F.lit(cut).alias("cut"), F.count(F.when(day <= cut, 1)).alias("train_rows"),
                     F.count(F.when(day > cut, 1)).alias("test_rows"))


@query("time_folds", f"""WITH {CUT}, f AS (SELECT d, CAST(least(floor((upto - m) * 6 / total), 5)
 AS INT) AS fold FROM (SELECT u.d, upto, total, m FROM u JOIN n ON u.d = n.d))
 SELECT fold, count(*) AS rows, min(l_shipdate) AS first, max(l_shipdate) AS last
 FROM lineitem JOIN f ON CAST(l_shipdate AS DATE) = d GROUP BY 1""")
def time_folds(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate")
    return training.time_folds(lines, "l_shipdate").groupBy("fold").agg(
        F.count("*").alias("rows"), F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"))


@query("top_rows", f"""WITH {R} SELECT race_id, horse_num, odds FROM r
 ORDER BY odds DESC, horse_num LIMIT 10""")
def top_rows(spark, sf):
    return profile.top_by(results(spark, sf, *KEY, "odds"),
                          [F.desc("odds"), F.asc("horse_num")], 10)


@query("last_rows", f"""WITH {R} SELECT race_id, horse_num, date_dt FROM r
 ORDER BY date_dt DESC, horse_num DESC LIMIT 10""")
def last_rows(spark, sf):
    return profile.top_by(results(spark, sf, *KEY, "date_dt"),
                          [F.desc("date_dt"), F.desc("horse_num")], 10)


@query("history_and_today", f"""WITH {R} SELECT race_id, horse_num, rank, CAST(NULL AS DOUBLE)
 AS weight FROM r WHERE day < 20 UNION ALL SELECT race_id, horse_num, NULL, weight FROM r
 WHERE day >= 20""")
def history_and_today(spark, sf):
    """Union of tables whose columns differ."""
    past = results(spark, sf, *KEY, "rank", "day").where("day < 20").drop("day")
    today = results(spark, sf, *KEY, "weight", "day").where("day >= 20").drop("day")
    return feat.history_and_today(past, today)


@query("distinct_contests", f"WITH {R} SELECT DISTINCT race_id FROM r")
def distinct_contests(spark, sf):
    return results(spark, sf, "race_id").distinct()
