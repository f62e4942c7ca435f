"""Contest tables derived from the given ``events`` and ``lineitem`` tables.

The column expressions are written once, in SQL both engines read, and used for the Spark
tables and for the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESULT_COLUMNS = {
    "event_id": "event_id",
    "race_id": "lpad(CAST(year(ts) AS STRING), 4, '0')"
               " || lpad(CAST(hour(ts) % 12 + 1 AS STRING), 2, '0')"
               " || lpad(CAST(month(ts) AS STRING), 2, '0')"
               " || lpad(CAST(day(ts) AS STRING), 2, '0')"
               " || lpad(CAST(hour(ts) + 1 AS STRING), 2, '0')",
    "horse_num": "CAST(event_id AS INT)",
    "horse_id": "CAST(user_id + 2015100000 AS STRING)",
    "horse_name": "'H' || CAST(user_id AS STRING)",
    "jockey_id": "CASE WHEN event_id % 97 = 0 THEN NULL"
                 " ELSE lpad(CAST(user_id % 20 + 1 AS STRING), 5, '0') END",
    "trainer_id": "lpad(CAST(user_id % 7 + 1 AS STRING), 5, '0')",
    "owner_id": "'O' || CAST(user_id % 23 AS STRING)",
    "sire_id": "'S' || CAST(user_id % 11 AS STRING)",
    "bms_id": "'B' || CAST(user_id % 13 AS STRING)",
    "breeder_id": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'R' || CAST(user_id % 9 AS STRING) END",
    "date_dt": "ts",
    "date": "CAST(year(ts) AS STRING) || '年' || CAST(month(ts) AS STRING) || '月'"
            " || CAST(day(ts) AS STRING) || '日'",
    "day": "CAST(day(ts) AS INT)",
    "period": "CAST(2020 + (day(ts) - 1 - (day(ts) - 1) % 6) / 6 AS INT)",
    "rank": "CAST((event_id * 7 + user_id) % 12 + 1 AS INT)",
    "odds": "1 + value / 10",
    "popularity": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 18 + 1 AS INT) END",
    "prize": "CAST(CASE (event_id * 7 + user_id) % 12 WHEN 0 THEN 100.5 WHEN 1 THEN 40.25"
             " WHEN 2 THEN 25.0 ELSE 0.0 END AS DOUBLE)",
    "agari_3f": "CASE WHEN event_id % 13 = 0 THEN NULL"
                " ELSE 33 + CAST(event_id % 64 AS DOUBLE) / 16 END",
    "passing_order": "CAST(event_id % 14 + 1 AS STRING) || '-'"
                     " || CAST((event_id * 3 + user_id) % 14 + 1 AS STRING)",
    "distance": "CAST(1000 + 200 * (hour(ts) % 10) AS INT)",
    "surface": "CASE day(ts) % 3 WHEN 0 THEN '芝' WHEN 1 THEN 'ダ' ELSE '障' END",
    "weather": "CASE hour(ts) % 3 WHEN 0 THEN '晴' WHEN 1 THEN '曇' ELSE '雨' END",
    "condition": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '良' ELSE '重' END",
    "gender": "CASE user_id % 3 WHEN 0 THEN '牡' WHEN 1 THEN '牝' ELSE 'セ' END",
    "age": "CAST(user_id % 6 + 2 AS INT)",
    "weight": "54 + CAST(event_id % 8 AS DOUBLE) / 4",
    "horse_weight": "CASE WHEN event_id % 17 = 0 THEN NULL"
                    " ELSE CAST(420 + user_id % 13 * 10 + event_id % 7 AS INT) END",
    "weight_change": "CAST(event_id % 13 - 6 AS INT)",
    "time": "CAST(1 + event_id % 2 AS STRING) || ':'"
            " || lpad(CAST(event_id % 30 + 10 AS STRING), 2, '0') || '.5'",
    "margin": "CASE event_id % 8 WHEN 0 THEN '1/2' WHEN 1 THEN 'ハナ' WHEN 2 THEN '大差'"
              " WHEN 3 THEN '1 1/4' WHEN 4 THEN '同着' WHEN 5 THEN '3' WHEN 6 THEN '取消'"
              " ELSE NULL END",
    "race_class": "event_type",
    "pred_prob": "CAST(event_id * 37 % 400 + 10 AS DOUBLE) / 1000",
    "pred_b": "CAST(event_id * 53 % 400 + 10 AS DOUBLE) / 1000",
}
_SELECT = ", ".join(f"{e} AS {n}" for n, e in RESULT_COLUMNS.items())
R = f"r AS (SELECT {_SELECT} FROM events)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def results(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The contest table; only the named columns when given."""
    names = columns or tuple(RESULT_COLUMNS)
    return table(spark, sf, "events").selectExpr(
        *[f"{RESULT_COLUMNS[n]} AS {n}" for n in names])


VENDOR_COLUMNS = {
    "年": "CAST(year(ts) % 100 AS INT)", "月": "CAST(month(ts) AS INT)",
    # Every third row is dated one day off, so only the coarse keys match it.
    "日": "CAST(CASE WHEN event_id % 3 = 0 THEN day(ts) % 28 + 1 ELSE day(ts) END AS INT)",
    "場所": "CASE hour(ts) % 12 + 1 WHEN 1 THEN '札幌' WHEN 2 THEN '函館' WHEN 3 THEN '福島'"
          " WHEN 4 THEN '新潟' WHEN 5 THEN '東京' WHEN 6 THEN '中山' WHEN 7 THEN '中京'"
          " WHEN 8 THEN '京都' WHEN 9 THEN '阪神' WHEN 10 THEN '小倉' ELSE '門別' END",
    "レース番号": "CAST(hour(ts) + 1 AS INT)",
    "血統登録番号": "CAST(CASE WHEN user_id % 10 = 0 THEN user_id ELSE user_id + 2015100000 END"
               " AS STRING)",
    "脚質": "CASE event_id % 9 WHEN 0 THEN '逃げ' WHEN 1 THEN 'ﾏｸﾘ' WHEN 2 THEN '先行'"
          " WHEN 3 THEN '差し' WHEN 4 THEN '追込' WHEN 5 THEN '中団' WHEN 6 THEN '後方'"
          " WHEN 7 THEN '?' ELSE NULL END",
    "PCI": "CASE WHEN event_id % 50 = 0 THEN '---'"
           " ELSE CAST(38 + event_id % 26 AS STRING) || '.5' END",
    "RPCI": "CAST(event_id % 31 + 40 AS STRING)",
    "PCI3": "CAST(event_id % 29 + 40 AS STRING)",
    "上り3F順位": "CAST(event_id % 18 + 1 AS STRING)",
    "Ave-3F": "CAST(33 + event_id % 5 AS STRING) || '.25'",
    "-3F差": "CAST(event_id % 5 - 2 AS STRING) || '.5'",
    "増減": "CAST(event_id % 61 - 30 AS STRING)",
    "通過順1角": "CAST(event_id % 16 + 1 AS STRING)",
    "通過順2角": "CAST(event_id % 15 + 1 AS STRING)",
    "通過順3角": "CAST(event_id % 14 + 1 AS STRING)",
    "通過順4角": "CAST(event_id % 13 + 1 AS STRING)",
    "確定着順": "CAST((event_id * 7 + user_id) % 12 + 1 AS DOUBLE)",
    "父タイプ": "'F' || CAST(user_id % 4 AS STRING)",
    "母父タイプ": "'M' || CAST(user_id % 3 AS STRING)",
    "人気": "CAST(event_id % 18 + 1 AS INT)",
    "単勝オッズ": "1 + value / 10",
    "補正タイム": "CAST(85 + event_id % 30 AS DOUBLE)",
    "ブリンカー": "CASE WHEN event_id % 7 = 0 THEN 'B' ELSE NULL END",
    "馬印1": "CASE event_id % 5 WHEN 0 THEN '◎' WHEN 1 THEN '○' WHEN 2 THEN '▲' ELSE NULL END",
    "event_id": "event_id",
}
V = "v AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in VENDOR_COLUMNS.items()) \
    + " FROM events)"


def vendor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        *[f"{e} AS `{n}`" for n, e in VENDOR_COLUMNS.items()])


# Order columns of an entrant's and an agent's rows; unique per row.
ENTRANT_ORDER = "date_dt, race_id, horse_num"
