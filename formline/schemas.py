"""Declared schemas of the input tables.  Ids are always text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T



RESULTS_DDL = """
race_id string, horse_num int, rank int, bracket int, horse_name string, horse_id string,
gender string, age int, jockey string, jockey_id string, trainer string, trainer_id string,
owner string, horse_weight int, weight_change int, time string, passing_order string,
agari_3f double, odds double, popularity int, prize double, date string, surface string,
distance int, weather string, condition string, race_laps string
"""
OLDER_RESULTS_DDL = RESULTS_DDL + """,
impost double, margin string, n_horses int, around string, race_class string, place string
"""
PAYOUTS_DDL = "race_id string, ticket_type string, horse_nums string, payout int"
HORSES_DDL = """
horse_id string, sire_name string, sire_id string, dam_name string, dam_id string,
bms_name string, bms_id string, owner_name string, owner_id string, breeder_name string,
breeder_id string, production_area string
"""
ENTRIES_DDL = """
race_id string, bracket int, horse_num int, horse_name string, horse_id string,
jockey string, jockey_id string, trainer string, trainer_id string, gender string, age int,
weight double, horse_weight int, weight_change int, odds double, popularity int,
surface string, distance int, weather string, condition string, date string
"""
PREDICTIONS_DDL = """
race_id string, horse_num int, pred_prob double, odds double, rank int, date string
"""
DAILY_RESULTS_DDL = "race_id string, win_horse_num int, win_payout int"

REQUIRED_PREDICTIONS = ["race_id", "horse_num", "pred_prob", "odds", "rank", "date"]


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the table has, in the wanted order."""
    present = set(df.columns)
    return [c for c in wanted if c in present]


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    skip = set(without)
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]
