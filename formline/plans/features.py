"""The feature pipeline: cleaning, derived columns, history, form, contest-relative columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators import agents, contest, history, joins
from formline.schemas import existing, missing_columns, numeric_columns
from formline.session import park
from formline.skew import BROADCAST_ROWS, HOT_ROWS, TASK_VALUES, bounded

# --- fixed values -----------------------------------------------------------------
OUTCOME_COLUMNS = (
    "rank", "time", "time_seconds", "target", "prize", "log_prize", "passing_order",
    "agari_3f", "margin", "margin_val", "corner_1コーナー", "corner_2コーナー",
    "corner_3コーナー", "corner_4コーナー", "race_laps", "running_style", "position_gain",
    "first_corner_pos", "final_corner_pos", "odds", "popularity", "log_odds", "is_win",
    "is_place", "is_show",
)
META_COLUMNS = (
    "race_id", "date", "date_dt", "horse_name", "jockey", "trainer", "horse_id",
    "jockey_id", "trainer_id", "owner", "owner_id", "sire_id", "dam_id", "bms_id",
    "breeder_id", "year", "place_code", "jockey_trainer_pair", "sire_name", "dam_name",
    "bms_name", "owner_name", "breeder_name",
)
INTERACTION_COLUMNS = (
    "sire_surface", "sire_distance", "bms_surface", "bms_distance", "jockey_place",
    "jockey_surface", "jockey_distance", "trainer_place", "trainer_surface",
    "trainer_distance", "owner_surface", "horse_jockey", "age_gender", "class_distance",
    "condition_surface",
)
RATE_COLUMNS = tuple(f"{a}_{f}_rate_100" for a in ("jockey", "trainer")
                     for f in ("win", "place", "show"))
RATIO_COLUMNS = ("impost_ratio", "weight_change_ratio")
FILL_POPULARITY, FILL_RATIO, FILL_MODEL = 99, 1.0, -999.0
ZERO_FILLED = (
    "bracket", "horse_num", "age", "odds", "horse_weight", "weight_change", "impost",
    "prev_rank", "ewma_rank_5", "log_prize", "log_odds", "rank_5_std", "rank_5_min",
    "rank_5_max", "prize_5_max", "interval", "month_sin", "month_cos", "avg_rank_Sprint",
    "avg_rank_Mile", "avg_rank_Intermediate", "avg_rank_Long", "avg_rank_turf",
    "avg_rank_dirt", "prev_rank_2", "prev_rank_3", "prev_prize_2", "prev_prize_3",
    "prev_odds_2", "prev_odds_3", "prev_pci", "prev_rpci", "prev_pci3",
    "prev_agari3f_rank", "prev_ave3f", "prev_3f_diff", "prev_running_style_jv",
    "prev_corner1", "prev_corner2", "prev_corner3", "prev_corner4", "prev_rank_jv",
    "weight_change_jv",
)
ZERO_FILLED_PARTS = ("_zscore", "_ratio_race_mean", "_diff_race_mean", "_diff_race_min",
                     "_diff_race_max", "rate_", "race_expected_", "race_max_", "race_pace_")
FILLED_UNKNOWN = ("jockey_id", "trainer_id", "owner_id", "place", "surface",
                  "distance_category", "horse_id", "sire_id", "bms_id")
# ----------------------------------------------------------------------------------


def central_only(df: DataFrame, contest_id: str = "race_id") -> DataFrame:
    """Rows of the central courses, by the course code in the contest id."""
    return df.where(S.place_code(contest_id).isin(S.CENTRAL_CODES))


def between_years(df: DataFrame, first: int | None = None, before: int | None = None,
                  year: str = "year") -> DataFrame:
    """Rows with first <= year < before."""
    y = F.col(year)
    if first is not None:
        df = df.where(y >= first)
    return df if before is None else df.where(y < before)


def on_date(df: DataFrame, day: str, date: str = "date_dt") -> DataFrame:
    return df.where(F.col(date).cast("date") == F.lit(day).cast("date"))


def with_basic_columns(df: DataFrame) -> DataFrame:
    """Time, place, categories, target, logs and margin, where their inputs exist."""
    made: dict[str, tuple[str, Column]] = {
        "time_seconds": ("time", S.clock_seconds("time")),
        "place": ("race_id", S.place_code("race_id")),
        "distance_category": ("distance", S.distance_category("distance")),
        "weight_bin": ("horse_weight", S.weight_bin("horse_weight")),
        "running_style": ("passing_order", S.running_style("passing_order")),
        "target": ("rank", S.is_winner("rank")),
        "log_prize": ("prize", S.log1p0("prize")),
        "log_odds": ("odds", S.log1p0("odds")),
        "margin_val": ("margin", S.margin_lengths("margin")),
    }
    present = set(df.columns)
    return df.withColumns({n: c for n, (source, c) in made.items() if source in present})


def with_unknown_filled(df: DataFrame) -> DataFrame:
    """Missing ids and contexts read ``unknown``; the rider/trainer pair is built before and
    keeps its missing ids as ``nan``."""
    has = set(df.columns)
    if {"jockey_id", "trainer_id"} <= has:
        df = df.withColumn("jockey_trainer_pair",
                           S.joined_key("jockey_id", "trainer_id", missing="nan"))
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
                           if c in has else F.lit("unknown") for c in FILLED_UNKNOWN})


def with_interactions(df: DataFrame) -> DataFrame:
    """Interaction keys for the target encoders, of a table with unknowns filled."""
    new = {f"{who}_{name}": S.joined_key(f"{who}_id", what)
           for who, contexts in {
               "sire": ("surface", "distance"), "bms": ("surface", "distance"),
               "jockey": ("place", "surface", "distance"),
               "trainer": ("place", "surface", "distance"), "owner": ("surface",)}.items()
           for name in contexts
           for what in ["distance_category" if name == "distance" else name]}
    new["horse_jockey"] = S.joined_key("horse_id", "jockey_id")
    pairs = {"age_gender": ("age", "gender"), "class_distance": ("race_class", "distance_category"),
             "condition_surface": ("condition", "surface")}
    now = set(df.columns)
    new |= {n: S.joined_key(a, b, missing="nan") for n, (a, b) in pairs.items()
            if {a, b} <= now}
    return df.withColumns(new)


def with_ratios(df: DataFrame) -> DataFrame:
    body = F.nullif(F.col("horse_weight"), F.lit(0))
    new = {n: S.safe_ratio(c, body) for n, c in
           {"impost_ratio": "weight", "weight_change_ratio": "weight_change"}.items()
           if {c, "horse_weight"} <= set(df.columns)}
    return df.withColumns(new) if new else df


def rate_means(df: DataFrame) -> dict[str, float]:
    """Mean of each rate column over the whole table: the fill values to keep with a model."""
    cols = existing(df, RATE_COLUMNS)
    if not cols:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in cols}


def means_of(results: DataFrame, horses: DataFrame | None = None) -> dict[str, float]:
    """``rate_means`` of the features of these rows; only the rates are built."""
    return rate_means(agents.with_all_agent_rates(prepared_rows(results, horses)))


def filled(df: DataFrame, means: dict[str, float] | None = None) -> DataFrame:
    """Fill policy: rates by their mean, popularity by 99, the other listed columns by 0.

    Ratio columns are not in the list and keep their NULLs.
    """
    means = rate_means(df) if means is None else means
    fills: dict[str, float] = {c: 0 for c in df.columns
                               if c in ZERO_FILLED or any(p in c for p in ZERO_FILLED_PARTS)}
    fills |= means
    fills["popularity"] = FILL_POPULARITY
    return df.withColumns({c: F.coalesce(S.number(c), F.lit(float(v)))
                           for c, v in fills.items() if c in df.columns})


def build_features(results: DataFrame, horses: DataFrame | None = None,
                   vendor: DataFrame | None = None, *, park_between: bool = True,
                   means: dict[str, float] | None = None, hot_rows: int = HOT_ROWS,
                   contests: DataFrame | None = None, **skew) -> DataFrame:
    """Results to features.

    With ``contests`` (ids, each once) only their rows are returned and written; the histories
    still run over all rows.  That needs ``means``.

    ``means`` are the fills of the rate columns; without them those of this table are taken.
    Rows that are scored later must be filled with the means kept with the model.

    Hot keys of agents, entrants and contests come from one counting pass, a table per key.
    Only narrow rows are shuffled: by agent, by entrant, and with vendor rows by their keys.  The
    histories that the contest columns read are built first, on their own, and reduced to a
    row per contest, so the wide rows are made and written once, in the tasks of the entrants.
    """
    def step(df, label, **options):
        return park(df, label, **options) if park_between else df

    if contests is not None and means is None:
        raise ValueError("give the means of the rate columns over the whole table")
    df = prepared_rows(results, horses)
    hot, rows = _counted_keys(
        df, [*agents.AGENTS.values(), history.ENTRANT, contest.CONTEST], hot_rows)
    # Rows that tie come in the same order wherever a history is built.
    df = df.withColumn(TIE, F.xxhash64(*existing(df, history.SOURCES)))
    entrants = {"hot": hot.get(history.ENTRANT), "rows": rows,
                "tiebreak": (*history.TIEBREAK, TIE)} | skew
    # Stops at the first readable date of the input.
    dated = vendor is not None and "date_dt" in results.columns and results.where(
        F.col("date_dt").isNotNull()).limit(1).count() > 0
    if contests is not None:
        df = agents.with_all_agent_rates(df, hot=hot, total=rows, **skew)
        ids = bounded(contests.select(contest.CONTEST, F.lit(True).alias(ASKED)),
                      contests.count())
        df = df.join(ids, contest.CONTEST, "left").select(*df.columns, ASKED)
        df = history.with_history(df, only=ASKED, **entrants).drop(TIE, ASKED)
        if vendor is not None:
            df = with_vendor(df, vendor, by_id_only=not dated)
        df = step(with_interactions(with_ratios(df)), "history")
        df = contest.with_contest_columns(df, hot=hot.get(contest.CONTEST))
        return filled(step(df, "features"), means)
    table = step(contest_rows(df, entrants), "contests")
    count = table.count()
    small = count <= BROADCAST_ROWS and count * len(table.columns) <= TASK_VALUES
    df = agents.with_all_agent_rates(df, hot=hot, total=rows, **skew)
    before = df.columns
    if vendor is not None:
        df = with_vendor(df, vendor, by_id_only=not dated)
    joined = [c for c in df.columns if c not in before]
    if not small:
        df = contest.with_contest_table(df, table)
    df = history.with_history(df, **entrants)
    df = df.select(*[c for c in df.columns if c not in (TIE, *joined)], *joined)
    if small:
        df = contest.with_contest_table(df, table, small=True)
    df = contest.with_contest_columns(with_interactions(with_ratios(df)), joined=True)
    return filled(step(df, "features", compression="zstd"), means)


TIE, ASKED = "_tie", "_asked"


def contest_rows(df: DataFrame, entrants: dict) -> DataFrame:
    """``contest_table`` of prepared rows; of the histories only what it reads is built."""
    narrow = df.select(*dict.fromkeys(existing(df, [
        contest.CONTEST, history.ENTRANT, history.DATE, *entrants["tiebreak"],
        *history.SOURCES])))
    return contest.contest_table(history.with_history(
        narrow, wanted=contest.contest_inputs(), **entrants))


def hot_by_key(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS
               ) -> dict[str, DataFrame | None]:
    """Per key column its values with more than ``limit`` rows, as ``skew.hot_keys`` finds them.

    All columns are counted in one pass over grouping sets, each task's rows first.
    """
    return _counted_keys(df, keys, limit)[0]


def _counted_keys(df: DataFrame, keys: Sequence[str], limit: int
                  ) -> tuple[dict[str, DataFrame | None], int | None]:
    """``hot_by_key`` and the number of rows, from the same pass."""
    keys = existing(df, keys)
    if not keys:
        return {}, None
    counts = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("_n"))
    seen = Observation()
    counts = counts.observe(seen, F.sum("_n").alias("rows"))
    # A row has a value in the one key that it counts, or none if that key is NULL.
    found = park(counts.where((F.col("_n") > limit) & F.coalesce(*[
        F.when(F.col(k).isNotNull(), True) for k in keys])), "hot-keys")
    number = found.agg(*[F.count(k).alias(k) for k in keys]).first()
    hot = {k: found.where(F.col(k).isNotNull()).select(k, "_n") if number[k] else None
           for k in keys}
    return hot, (seen.get["rows"] or 0) // len(keys)


def prepared_rows(results: DataFrame, horses: DataFrame | None = None) -> DataFrame:
    """Rows with dimension, derived columns and unknowns filled: what the windows read."""
    df = results if "sire_id" in results.columns else joins.with_dimension(results, horses)
    return with_unknown_filled(with_basic_columns(df))


BASELINE_ZSCORES = {"horse_weight": "weight_zscore", "age": "age_zscore", "odds": "odds_zscore",
                    "ewma_prize_5": "ewma_prize_zscore"}


def build_baseline_features(results: DataFrame, **skew) -> DataFrame:
    """The first-generation features: dead-even target, short history, four z-scores."""
    df = with_basic_columns(results)
    if {"jockey_id", "trainer_id"} <= set(df.columns):
        df = df.withColumn("jockey_trainer_pair",
                           S.joined_key("jockey_id", "trainer_id", missing="nan"))
    df = contest.with_dead_even_target(df, **skew)
    wide = park(history.with_baseline_history(df, **skew), "baseline")
    return contest.with_zscores(wide, BASELINE_ZSCORES, **skew)


VENDOR_VALUES = (*history.VENDOR_LAGS.values(), "sire_type", "bms_type", "weight_change_jv")


def with_vendor(df: DataFrame, vendor: DataFrame, by_id_only: bool = False) -> DataFrame:
    """Vendor columns by (entrant, date, place, number); the year stands in for a date that
    does not match.

    ``by_id_only`` takes the entrant's last known values instead, for tables in which no date
    can be read; a table without ``date_dt`` or ``race_id`` is always joined that way.
    """
    values = existing(vendor, VENDOR_VALUES)
    if by_id_only or not {"date_dt", "race_id"} <= set(df.columns):
        latest = joins.latest_known(vendor, ["horse_id_jv"], ["date_jv"], values)
        return joins.with_exact_match(df.withColumn("_id", S.canonical_id("horse_id")), latest,
                                      {"_id": "horse_id_jv"}, values, ["horse_id_jv"]).drop("_id")
    keyed = df.withColumns({
        "_id": S.canonical_id("horse_id"), "_day": F.col("date_dt").cast("date"),
        "_place": S.place_code("race_id"),
        "_no": F.substring("race_id", 11, 2).try_cast("int"),
        "_year": F.substring("race_id", 1, 4).try_cast("int")})
    other = vendor.withColumn("_year_jv", F.year("date_jv"))
    same = {"_id": "horse_id_jv", "_place": "place_code_jv", "_no": "レース番号"}
    out = joins.with_two_tier_match(keyed, other, {**same, "_day": "date_jv"},
                                    {**same, "_year": "_year_jv"}, values,
                                    ["date_jv", *values])
    return out.drop("_id", "_day", "_place", "_no", "_year", "match_tier")


def model_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are known before the contest."""
    return numeric_columns(df, {*OUTCOME_COLUMNS, *META_COLUMNS, *INTERACTION_COLUMNS,
                                *without})


def aligned(df: DataFrame, features: Sequence[str], fill: float = FILL_MODEL) -> DataFrame:
    """Exactly the model's columns as doubles: missing ones are added, NULLs filled."""
    lacking = set(missing_columns(df, features))
    return df.withColumns({c: F.lit(fill) if c in lacking
                           else F.coalesce(F.col(c).cast("double"), F.lit(fill))
                           for c in features})


def history_and_today(past: DataFrame, today: DataFrame) -> DataFrame:
    return past.unionByName(today, allowMissingColumns=True)


def relevant_history(past: DataFrame, today: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Past rows that share an entrant or agent with today's rows.

    Today's ids are few (counted, then broadcast), so the past is filtered where it is read.
    """
    marks = []
    for i, k in enumerate(keys):
        ids = park(today.select(F.col(k).alias(f"_id{i}")).where(F.col(k).isNotNull())
                   .distinct(), "today-ids")
        past = past.join(bounded(ids, ids.count()), F.col(k) == F.col(f"_id{i}"), "left")
        marks.append(f"_id{i}")
    known = reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in marks])
    return past.where(known).drop(*marks)
