"""Columns relative to the other entrants of the same contest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.functions import scalars as S
from formline.skew import OrderedRows, with_group_stats

CONTEST = "race_id"
# Fixed values.
RELATIVE = ("horse_weight", "age", "weight", "prev_rank", "prev_prize", "prev_agari_3f",
            "interval", "rank_5_mean", "prize_5_mean", "agari_3f_5_mean",
            "position_gain_5_mean")
PACE_STYLES = ("Nigeru", "Senko", "Oikomi")
LEAD_WEIGHT = 1.5
TINY = 1e-6


def contest_stats(columns: Sequence[str]) -> dict[str, Column]:
    """``{column}_race_{mean,std,min,max}`` aggregates."""
    stats = {}
    for c in columns:
        stats |= {f"{c}_race_mean": F.avg(c), f"{c}_race_std": F.stddev_samp(c),
                  f"{c}_race_min": F.min(c), f"{c}_race_max": F.max(c)}
    return stats


def pace_stats() -> dict[str, Column]:
    stats = {}
    for s in PACE_STYLES:
        stats |= {f"race_expected_{s}_count": F.sum(f"rate_{s}_5"),
                  f"race_max_{s}_prob": F.max(f"rate_{s}_5")}
    return stats


def relative_columns(c: str) -> dict[str, Column]:
    x, mean, std = F.col(c), F.col(f"{c}_race_mean"), F.col(f"{c}_race_std")
    return {
        f"{c}_diff_race_mean": x - mean,
        f"{c}_zscore": F.try_divide(x - mean, std + TINY),
        f"{c}_ratio_race_mean": F.try_divide(x, mean + TINY),
        f"{c}_diff_race_min": x - F.col(f"{c}_race_min"),
        f"{c}_diff_race_max": x - F.col(f"{c}_race_max"),
    }


def with_relative(df: DataFrame, columns: Sequence[str] = RELATIVE, contest: str = CONTEST,
                  **skew) -> DataFrame:
    """Nine columns per input column: contest mean/std/min/max, differences, z-score, ratio."""
    return with_contest_columns(df, columns, False, contest, **skew)


def with_pace(df: DataFrame, contest: str = CONTEST, **skew) -> DataFrame:
    """Expected number and strongest tendency of each style, and the pace index."""
    return with_contest_columns(df, (), True, contest, **skew)


def contest_inputs(columns: Sequence[str] = RELATIVE, pace: bool = True) -> list[str]:
    """The columns that ``with_contest_columns`` reads."""
    return [*columns, *[f"rate_{s}_5" for s in PACE_STYLES if pace]]


def contest_table(df: DataFrame, columns: Sequence[str] = RELATIVE, pace: bool = True,
                  contest: str = CONTEST) -> DataFrame:
    """One row per contest: what ``with_contest_columns`` needs to know of its rows.

    An aggregate with partial results per task; only the columns that it reads are moved.
    """
    present = [c for c in columns if c in set(df.columns)]
    rows = df.where(F.col(contest).isNotNull())
    rows = rows.withColumns({c: S.number(c) for c in present}) if present else rows
    stats = contest_stats(present) | (pace_stats() if pace else {})
    return rows.groupBy(contest).agg(*[v.alias(n) for n, v in stats.items()])


def with_contest_table(df: DataFrame, table: DataFrame, contest: str = CONTEST,
                       small: bool = False) -> DataFrame:
    """Rows plus the columns of ``contest_table``; ``small`` tables are broadcast.

    Rows without a contest match nothing; they are spread over many tasks.
    """
    if small:
        return df.join(F.broadcast(table), contest, "left").select(
            *df.columns, *[c for c in table.columns if c != contest])
    spread = F.when(F.col(contest).isNull(), F.pmod(F.xxhash64(*[
        f.name for f in df.schema if not isinstance(f.dataType, T.MapType)][:8]), F.lit(4096)))
    other = table.withColumnRenamed(contest, "_contest").withColumn(
        "_none", F.lit(0).cast("long"))
    rows = df.withColumn("_spread", F.coalesce(spread, F.lit(0)).cast("long"))
    match = (F.col(contest) == F.col("_contest")) & (F.col("_spread") == F.col("_none"))
    return rows.join(other, match, "left").drop("_spread", "_contest", "_none")


def with_contest_columns(df: DataFrame, columns: Sequence[str] = RELATIVE, pace: bool = True,
                         contest: str = CONTEST, joined: bool = False, **skew) -> DataFrame:
    """Relative and pace columns from one grouping by contest.

    ``joined``: the columns of ``contest_table`` are there already.
    """
    present = [c for c in columns if c in set(df.columns)]
    df = df.withColumns({c: S.number(c) for c in present}) if present else df
    stats = contest_stats(present) | (pace_stats() if pace else {})
    wide = df.select(*[c for c in df.columns if c not in stats], *stats) if joined \
        else with_group_stats(df, [contest], stats, **skew)
    new = {n: v for c in present for n, v in relative_columns(c).items()}
    if pace:
        count = {s: F.coalesce(F.col(f"race_expected_{s}_count"), F.lit(0.0))
                 for s in PACE_STYLES}
        new |= {f"race_expected_{s}_count": count[s] for s in PACE_STYLES}
        new["race_pace_index"] = count["Nigeru"] * LEAD_WEIGHT + count["Senko"]
    return wide.withColumns(new)


def with_zscores(df: DataFrame, columns: dict[str, str], contest: str = CONTEST,
                 **skew) -> DataFrame:
    """z-scores with 0 for missing values; ``columns`` maps column -> new name."""
    df = df.withColumns({c: F.coalesce(S.number(c), F.lit(0.0)) for c in columns})
    stats = {}
    for c in columns:
        stats |= {f"_m_{c}": F.avg(c), f"_d_{c}": F.stddev_samp(c)}
    wide = with_group_stats(df, [contest], stats, **skew)
    return wide.select(*df.columns, *[
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_d_{c}") + TINY),
                   F.lit(0.0)).alias(name) for c, name in columns.items()])


def with_winner_time(df: DataFrame, contest: str = CONTEST, position: str = "rank",
                     seconds: str = "time_seconds", **skew) -> DataFrame:
    return with_group_stats(
        df, [contest], {"winner_time": F.min(F.when(F.col(position) == 1, F.col(seconds)))},
        **skew)


def with_dead_even_target(df: DataFrame, contest: str = CONTEST, position: str = "rank",
                          seconds: str = "time_seconds", **skew) -> DataFrame:
    """``target``: winner, or second in the winner's time."""
    even = (F.col(position) == 2) & (F.col(seconds) == F.col("winner_time"))
    wide = with_winner_time(df, contest, position, seconds, **skew)
    return wide.withColumn(
        "target", F.when(F.coalesce(even, F.lit(False)), 1).otherwise(S.is_winner(position))
    ).drop("winner_time")


def with_display_order(df: DataFrame, prob: str = "pred_prob", entry: str = "horse_num",
                       contest: str = CONTEST, **skew) -> DataFrame:
    """``display_order``: 1.. by probability, highest first, within the contest."""
    ordered = df.withColumn("_down", -F.col(prob))
    o = OrderedRows(ordered, [contest], ["_down", entry], **skew)
    return o.finish(o.running({"_earlier": F.lit(1)})).select(
        *df.columns, (F.coalesce("_earlier", F.lit(0)) + 1).cast("int").alias("display_order"))


def with_normalised_probability(df: DataFrame, prob: str = "pred_prob",
                                contest: str = CONTEST, enabled: bool = True,
                                **skew) -> DataFrame:
    """Optionally scale probabilities to sum to 1 per contest (unchanged if the sum is 0)."""
    if not enabled:
        return df.withColumn("norm_prob", F.col(prob))
    wide = with_group_stats(df, [contest], {"_sum": F.sum(prob)}, **skew)
    scaled = F.when(F.col("_sum") > 0, F.col(prob) / F.col("_sum")).otherwise(F.col(prob))
    return wide.withColumn("norm_prob", scaled).drop("_sum")


def with_field_size(df: DataFrame, contest: str = CONTEST, **skew) -> DataFrame:
    return with_group_stats(df, [contest], {"n_horses": F.count("*")}, **skew)


def well_covered_contests(df: DataFrame, column: str = "horse_weight", share: float = 0.5,
                          contest: str = CONTEST, **skew) -> DataFrame:
    """Keep contests where at least ``share`` of the rows have a value."""
    known = F.avg(F.col(column).isNotNull().cast("double"))
    wide = with_group_stats(df, [contest], {"_known": known}, **skew)
    return wide.where(F.col("_known") >= share).drop("_known")
