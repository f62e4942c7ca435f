"""Entrant and agent history."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import ENTRANT_ORDER, R, V, results, table, vendor
from formline.functions import scalars as S
from formline.operators import agents, history
from formline.skew import OrderedRows
from formline.sources import tables as src

KEY = ("race_id", "horse_num")
ENT = f"PARTITION BY horse_id ORDER BY {ENTRANT_ORDER}"
STYLE = """CASE WHEN last_pos IS NULL THEN 'Unknown' WHEN last_pos = 1 THEN 'Nigeru'
 WHEN last_pos <= 4 THEN 'Senko' WHEN last_pos <= 9 THEN 'Sashi' ELSE 'Oikomi' END"""
P = f"""{R}, p AS (SELECT *, CAST(split_part(passing_order, '-', 1) AS INT) AS first_pos,
 CAST(split_part(passing_order, '-', -1) AS INT) AS last_pos FROM r),
 s AS (SELECT *, first_pos AS first_corner_pos, last_pos AS final_corner_pos,
 last_pos - first_pos AS position_gain, {STYLE} AS running_style FROM p)"""


def entrants(spark, sf, *columns, **skew):
    df = results(spark, sf, *dict.fromkeys(("race_id", "horse_num", "horse_id", "date_dt",
                                            *columns)))
    return history.entrant_rows(df, **skew)


def selected(o, new, keep=KEY):
    names = list(new)
    out = o.finish(o.rows.select("*", *[c.alias(n) for n, c in new.items()]))
    return out.select(*keep, *names)


# --- lags, gaps, flags ------------------------------------------------------------

LAG_SQL = ", ".join(
    f"coalesce(lag({c}, {k}) OVER w, {fill}) AS {n}" if fill is not None
    else f"lag({c}, {k}) OVER w AS {n}" for c, k, n, fill in history.LAGS)
GAP_SQL = ("CAST(coalesce(date_diff('day', CAST(lag(date_dt) OVER w AS DATE),"
           " CAST(date_dt AS DATE)), 0) AS INT) AS interval")


@query("history_lags", f"""WITH {R} SELECT race_id, horse_num, {LAG_SQL} FROM r
 WINDOW w AS ({ENT})""", ["prev_odds", "prev_odds_2", "prev_odds_3"])
def history_lags(spark, sf):
    o = entrants(spark, sf, "rank", "prize", "odds", "popularity", "agari_3f", halo=3)
    return selected(o, history.lags(o))


@query("history_gap_and_flags", f"""WITH {R} SELECT race_id, horse_num, {GAP_SQL},
 CASE WHEN jockey_id = lag(jockey_id) OVER w THEN 1 ELSE 0 END AS same_jockey,
 sin(2 * pi() * month(date_dt) / 12) AS month_sin,
 cos(2 * pi() * month(date_dt) / 12) AS month_cos
 FROM r WINDOW w AS ({ENT})""", ["month_sin", "month_cos"])
def history_gap_and_flags(spark, sf):
    o = entrants(spark, sf, "jockey_id", halo=1)
    month_sin, month_cos = S.month_cycle("date_dt")
    return selected(o, {"interval": history.day_gap(o),
                        "same_jockey": history.same_as_last(o, "jockey_id"),
                        "month_sin": month_sin, "month_cos": month_cos})


# --- rolling ----------------------------------------------------------------------

SQL_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum",
           "median": "median"}


def rolling_sql(targets, windows, source=f"{P} SELECT", table_name="s"):
    columns, frames = [], []
    for w in windows:
        frames.append(f"w{w} AS ({ENT} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)")
    for c, hows in targets.items():
        for w in windows:
            for how in hows:
                columns.append(f"CAST({SQL_AGG[how]}({c}) OVER w{w} AS DOUBLE) AS {c}_{w}_{how}")
    return f"""WITH {source} race_id, horse_num, {', '.join(columns)} FROM {table_name}
 WINDOW {', '.join(frames)}"""


def rolling_names(targets, windows):
    return [f"{c}_{w}_{how}" for c, hows in targets.items() for w in windows for how in hows]


POSITIONS = ("first_corner_pos", "final_corner_pos", "position_gain")


def with_positions(spark, sf, targets):
    plain = [c for c in targets if c not in POSITIONS]
    df = results(spark, sf, *dict.fromkeys((
        "race_id", "horse_num", "horse_id", "date_dt", "passing_order", *plain)))
    return df.withColumns(history.position_columns())


@query("history_rolling", rolling_sql(history.ROLLING, history.WINDOWS),
       rolling_names(history.ROLLING, history.WINDOWS), 9)
def history_rolling(spark, sf):
    o = history.entrant_rows(with_positions(spark, sf, history.ROLLING))
    names = list(history.rolling(o))
    return o.finish(history.with_rolling(o)).select(*KEY, *names)


MEANS = {"rank": ("mean",), "prize": ("mean",), "odds": ("mean",)}


@query("history_rolling_means", rolling_sql(MEANS, (3, 5), f"{R} SELECT", "r"),
       rolling_names(MEANS, (3, 5)), 9)
def history_rolling_means(spark, sf):
    o = entrants(spark, sf, *MEANS, halo=5)
    return selected(o, history.rolling(o, MEANS, (3, 5)))


SLICED = {"rank": ("mean", "std", "median"), "odds": ("max",), "popularity": ("mean",)}


@query("history_rolling_sliced", rolling_sql(SLICED, (3, 10), f"{R} SELECT", "r"),
       rolling_names(SLICED, (3, 10)), 9)
def history_rolling_sliced(spark, sf):
    """The rolling columns on the path for hot keys: every entrant is cut into slices."""
    o = entrants(spark, sf, *SLICED, halo=10, hot_rows=30, slice_rows=16)
    return selected(o, history.rolling(o, SLICED, (3, 10)))


@query("history_momentum", f"""WITH {R} SELECT race_id, horse_num,
 avg(rank) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
 - coalesce(lag(rank) OVER w, 99) AS rank_momentum_5 FROM r WINDOW w AS ({ENT})""",
       ["rank_momentum_5"])
def history_momentum(spark, sf):
    o = entrants(spark, sf, "rank", halo=5)
    mean = history.rolling(o, {"rank": ("mean",)}, (5,))["rank_5_mean"]
    return selected(o, {"rank_momentum_5": mean - history.lags(o)["prev_rank"]})


RATES = [f"rate_{c}_{w}" for c in history.STYLES for w in history.STYLE_WINDOWS]
RATE_SQL = ", ".join(
    f"coalesce(avg(CASE WHEN running_style = '{c}' THEN 1 ELSE 0 END) OVER "
    f"({ENT} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS rate_{c}_{w}"
    for c in history.STYLES for w in history.STYLE_WINDOWS)


@query("history_style_rates", f"WITH {P} SELECT race_id, horse_num, {RATE_SQL} FROM s", RATES)
def history_style_rates(spark, sf):
    df = results(spark, sf, "race_id", "horse_num", "horse_id", "date_dt", "passing_order")
    df = df.withColumn("running_style", S.running_style("passing_order"))
    o = history.entrant_rows(df, halo=10)
    return selected(o, history.category_rates(o))


# --- expanding and decayed --------------------------------------------------------

D = f"""{R}, d AS (SELECT *, substr(race_id, 5, 2) AS place,
 CASE WHEN distance < 1400 THEN 'Sprint' WHEN distance < 1800 THEN 'Mile'
 WHEN distance < 2200 THEN 'Intermediate' ELSE 'Long' END AS distance_category FROM r)"""
CONTEXTS = (
    {c: f"distance_category = '{c}'" for c in history.DISTANCES}
    | {n: f"surface = '{s}'" for s, n in history.SURFACES.items()}
    | {f"place_{p}": f"place = '{p}'" for p in history.PLACES})
SUITABILITY = [f"avg_rank_{n}" for n in CONTEXTS]
SUITABILITY_SQL = f"WITH {D} SELECT race_id, horse_num, " + ", ".join(
    f"coalesce(avg(CASE WHEN {cond} THEN rank END) OVER w, 99) AS avg_rank_{n}"
    for n, cond in CONTEXTS.items()
) + f" FROM d WINDOW w AS ({ENT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def suitability(spark, sf, **skew):
    df = results(spark, sf, "race_id", "horse_num", "horse_id", "date_dt", "distance",
                 "surface", "rank")
    df = df.withColumns({"place": S.place_code("race_id"),
                         "distance_category": S.distance_category("distance")})
    o = history.entrant_rows(df, halo=0, **skew)
    return o.finish(history.with_suitability(o)).select(*KEY, *SUITABILITY)


@query("history_suitability", SUITABILITY_SQL, SUITABILITY)
def history_suitability(spark, sf):
    return suitability(spark, sf)


@query("history_suitability_sliced", SUITABILITY_SQL, SUITABILITY)
def history_suitability_sliced(spark, sf):
    """Expanding means on the path for hot keys, with sums carried between slices."""
    return suitability(spark, sf, hot_rows=40, slice_rows=16)


LINES = """b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey
 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS x FROM lineitem)"""
# All earlier rows, none cut.
DECAY_SQL = f"""WITH {LINES} SELECT a.l_suppkey, a.l_orderkey, a.l_linenumber, a.l_partkey,
 sum(c.x * power(2 / 3.0, a.rn - c.rn)) / sum(CASE WHEN c.x IS NULL THEN NULL
 ELSE power(2 / 3.0, a.rn - c.rn) END) AS ewma
 FROM b a LEFT JOIN b c ON a.l_suppkey = c.l_suppkey AND c.rn < a.rn
 GROUP BY a.l_suppkey, a.l_orderkey, a.l_linenumber, a.l_partkey, a.rn"""


def decayed(spark, sf, **skew):
    df = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("x"))
    o = OrderedRows(df, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                    halo=history.decay_rows(5), **skew)
    return o.finish(history.with_decayed_means(o, {"ewma": "x"})).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "ewma")


@query("history_decayed", DECAY_SQL, ["ewma"])
def history_decayed(spark, sf):
    return decayed(spark, sf)


@query("history_decayed_sliced", DECAY_SQL, ["ewma"])
def history_decayed_sliced(spark, sf):
    """Decayed means on the path for hot keys."""
    return decayed(spark, sf, hot_rows=150, slice_rows=100)


BASELINE = ["avg_rank_5", "ewma_rank_5", "ewma_prize_5", "prev_time_seconds", "prev_odds",
            "avg_weight_change_5", "avg_rank_turf", "avg_rank_dirt", "prev_prize"]


def ewma_sql(c, name, fill):
    return f"""coalesce((SELECT sum(e.{c} * power(2 / 3.0, q.rn - e.rn))
 / sum(CASE WHEN e.{c} IS NOT NULL THEN power(2 / 3.0, q.rn - e.rn) END)
 FROM q e WHERE e.horse_id = q.horse_id AND e.rn < q.rn), {fill}) AS {name}"""


@query("history_baseline", f"""WITH {R}, q AS (SELECT *, row_number() OVER ({ENT}) AS rn,
 CAST(split_part(time, ':', 1) AS DOUBLE) * 60 + CAST(split_part(time, ':', 2) AS DOUBLE)
 AS time_seconds FROM r)
 SELECT race_id, horse_num, coalesce(lag(rank) OVER w, 99) AS prev_rank,
 coalesce(avg(rank) OVER w5, 99) AS avg_rank_5,
 coalesce(lag(prize) OVER w, 0) AS prev_prize,
 coalesce(lag(time_seconds) OVER w, 0) AS prev_time_seconds,
 coalesce(lag(odds) OVER w, 0) AS prev_odds,
 coalesce(avg(weight_change) OVER w5, 0) AS avg_weight_change_5,
 {ewma_sql('rank', 'ewma_rank_5', 99)}, {ewma_sql('prize', 'ewma_prize_5', 0)},
 coalesce(avg(CASE WHEN surface = '芝' THEN rank END) OVER wu, 99) AS avg_rank_turf,
 coalesce(avg(CASE WHEN surface = 'ダ' THEN rank END) OVER wu, 99) AS avg_rank_dirt
 FROM q WINDOW w AS ({ENT}), w5 AS ({ENT} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
 wu AS ({ENT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", BASELINE)
def history_baseline(spark, sf):
    df = results(spark, sf, "race_id", "horse_num", "horse_id", "date_dt", "rank", "prize",
                 "odds", "surface", "weight_change", "time")
    df = df.withColumn("time_seconds", S.clock_seconds("time"))
    return history.with_baseline_history(df).select(*KEY, "prev_rank", *BASELINE)


# --- vendor history ---------------------------------------------------------------

STYLE_CODE = "CASE 脚質 " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in S.STYLE_CODES.items()) + " ELSE 0 END"
VENDOR_SQL = f"""{V}, vd AS (SELECT *, make_date(2000 + 年, 月, 日) AS date_jv,
 "血統登録番号" AS horse_id_jv, {STYLE_CODE} AS running_style_encoded FROM v)"""
VENDOR_LAG_SQL = ", ".join(
    f'lag(TRY_CAST("{c}" AS DOUBLE)) OVER w AS {n}' for c, n in history.VENDOR_LAGS.items())


FIGURES = ", ".join(f'TRY_CAST("{c}" AS DOUBLE) NULLS LAST' for c in history.VENDOR_LAGS)


# Rows of one date and number are ordered by their figures.
@query("history_vendor", f"""WITH {VENDOR_SQL} SELECT event_id, {VENDOR_LAG_SQL} FROM vd
 WINDOW w AS (PARTITION BY horse_id_jv ORDER BY date_jv, "レース番号", {FIGURES})""",
       list(history.VENDOR_LAGS.values()))
def history_vendor(spark, sf):
    df = src.vendor_table(vendor(spark, sf))
    return history.vendor_history(df).select(
        "event_id", *history.VENDOR_LAGS.values())


# --- agents -----------------------------------------------------------------------

def rate_sql(source, agent, prefix, order, position="rank"):
    frame = f"(PARTITION BY {agent} ORDER BY {order} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
    return ", ".join(
        f"CASE WHEN {agent} IS NOT NULL AND count({position}) OVER {frame} >= 10 THEN"
        f" avg(CASE WHEN {position} <= {k} THEN 1 WHEN {position} IS NOT NULL THEN 0 END)"
        f" OVER {frame} END AS {prefix}_{n}_rate_100" for n, k in agents.FLAGS.items())


AGENT_RATES = [f"{a}_{n}_rate_100" for a in agents.AGENTS for n in agents.FLAGS]


@query("agent_rates", f"""WITH {R} SELECT race_id, horse_num,
 {rate_sql('r', 'jockey_id', 'jockey', ENTRANT_ORDER)},
 {rate_sql('r', 'trainer_id', 'trainer', ENTRANT_ORDER)} FROM r""", AGENT_RATES)
def agent_rates(spark, sf):
    df = results(spark, sf, "race_id", "horse_num", "date_dt", "jockey_id", "trainer_id", "rank")
    return agents.with_all_agent_rates(df).select(*KEY, *AGENT_RATES)


BY_CONTEST = "race_id, horse_num"


@query("agent_rates_by_contest_id", f"""WITH {R}, a AS (SELECT race_id, horse_num,
 {rate_sql('r', 'jockey_id', 'jockey', BY_CONTEST)},
 {rate_sql('r', 'trainer_id', 'trainer', BY_CONTEST)} FROM r)
 SELECT race_id, horse_num, {', '.join(f'coalesce({c}, 0) AS {c}' for c in AGENT_RATES)}
 FROM a""", AGENT_RATES)
def agent_rates_by_contest_id(spark, sf):
    """Ordered by contest id alone, without history 0."""
    df = results(spark, sf, *KEY, "jockey_id", "trainer_id", "rank")
    out = agents.with_all_agent_rates(df, order=("race_id", "horse_num"))
    return out.fillna(0.0, AGENT_RATES).select(*KEY, *AGENT_RATES)


SUPPLIER_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
SUPPLIER_RATES = [f"supplier_{n}_rate_100" for n in agents.FLAGS]
SUPPLIER_SQL = f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
 {rate_sql('lineitem', 'l_suppkey', 'supplier', SUPPLIER_ORDER, 'l_linenumber')} FROM lineitem"""


def supplier_rates(spark, sf, **skew):
    df = table(spark, sf, "lineitem").select("l_suppkey", *SUPPLIER_ORDER.split(", "))
    out = agents.with_agent_rates(df, "l_suppkey", "supplier", position="l_linenumber",
                                  order=SUPPLIER_ORDER.split(", "), **skew)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *SUPPLIER_RATES)


@query("agent_rates_supplier", SUPPLIER_SQL, SUPPLIER_RATES)
def agent_rates_supplier(spark, sf):
    return supplier_rates(spark, sf)


@query("agent_rates_supplier_sliced", SUPPLIER_SQL, SUPPLIER_RATES)
def agent_rates_supplier_sliced(spark, sf):
    """Agent rates on the path for hot keys: every supplier is cut into slices."""
    return supplier_rates(spark, sf, hot_rows=150, slice_rows=128)
