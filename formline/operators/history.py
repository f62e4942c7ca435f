"""Look-ahead-free history of an entrant: lags, rolling, expanding, decayed values.

Every frame ends one row before the current row and never crosses entrants.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.functions import scalars as S
from formline.skew import OrderedRows, nulls_last

# --- fixed values: targets, windows and fills of the feature set ------------------
WINDOWS = (3, 5, 10, 100)
ROLLING = {
    "rank": ("mean", "std", "min", "max", "median"),
    "prize": ("mean", "sum", "max"),
    "agari_3f": ("mean", "min", "median"),
    "first_corner_pos": ("mean", "median"),
    "final_corner_pos": ("mean", "median"),
    "position_gain": ("mean", "min", "max"),
    "odds": ("mean", "std", "min", "max"),
    "popularity": ("mean", "max"),
    "weight": ("mean", "std"),
    "horse_weight": ("mean", "std", "min", "max", "median"),
}
LAGS = (  # column, steps, new name, fill
    ("rank", 1, "prev_rank", 99), ("rank", 2, "prev_rank_2", 99),
    ("rank", 3, "prev_rank_3", 99),
    ("prize", 1, "prev_prize", 0), ("prize", 2, "prev_prize_2", 0),
    ("prize", 3, "prev_prize_3", 0),
    ("odds", 1, "prev_odds", None), ("odds", 2, "prev_odds_2", None),
    ("odds", 3, "prev_odds_3", None),
    ("popularity", 1, "prev_popularity", None), ("agari_3f", 1, "prev_agari_3f", None),
)
STYLES = ("Nigeru", "Senko", "Sashi", "Oikomi")
STYLE_WINDOWS = (5, 10)
DISTANCES = ("Sprint", "Mile", "Intermediate", "Long")
SURFACES = {"芝": "turf", "ダ": "dirt"}
PLACES = tuple(f"{i:02d}" for i in range(1, 11))
NO_RANK = 99
VENDOR_LAGS = {
    "PCI": "prev_pci", "RPCI": "prev_rpci", "PCI3": "prev_pci3",
    "上り3F順位": "prev_agari3f_rank", "Ave-3F": "prev_ave3f", "-3F差": "prev_3f_diff",
    "running_style_encoded": "prev_running_style_jv",
    "通過順1角": "prev_corner1", "通過順2角": "prev_corner2",
    "通過順3角": "prev_corner3", "通過順4角": "prev_corner4", "確定着順": "prev_rank_jv",
}
# ----------------------------------------------------------------------------------

ENTRANT, DATE = "horse_id", "date_dt"
TIEBREAK = ("race_id", "horse_num")
BLOCK_WEIGHT = 1e-150  # weight of a whole block of decayed rows; its square is still a double
LONGEST = max(WINDOWS)


def entrant_rows(df: DataFrame, entrant: str = ENTRANT, date: str = DATE,
                 tiebreak: Sequence[str] = TIEBREAK, halo: int = LONGEST,
                 **skew) -> OrderedRows:
    return OrderedRows(df, [entrant], [date, *tiebreak], halo=halo, **skew)


def filled(c: Column, fill) -> Column:
    return c if fill is None else F.coalesce(c, F.lit(fill))


def aggregate_of(value: Column, how: str) -> Column:
    if how == "median":
        return F.percentile(value, F.lit(0.5))
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
            "sum": F.sum}[how](value)


def lags(o: OrderedRows, spec=LAGS) -> dict[str, Column]:
    present = set(o.rows.columns)
    return {name: filled(o.over(F.lag(c, k), o.spec), fill) for c, k, name, fill in spec
            if c in present}


def day_gap(o: OrderedRows, date: str = DATE) -> Column:
    """Whole days since the entrant's previous row, 0 on the first."""
    previous = o.over(F.lag(date, 1), o.spec)
    return F.coalesce(F.datediff(F.col(date).cast("date"), previous.cast("date")), F.lit(0))


def same_as_last(o: OrderedRows, column: str) -> Column:
    return F.coalesce(F.col(column) == o.over(F.lag(column, 1), o.spec),
                      F.lit(False)).cast("int")


def rolling(o: OrderedRows, targets=None, windows: Sequence[int] = WINDOWS
            ) -> dict[str, Column]:
    """``{target}_{window}_{function}`` over the last ``window`` rows."""
    present = set(o.rows.columns)
    return {
        f"{c}_{w}_{how}": o.over(agg, o.last(w))
        for c, hows in (targets or ROLLING).items() if c in present
        for how in hows for agg in [aggregate_of(F.col(c), how)] for w in windows
    }


ROWS_AT_ONCE = 1024  # rows whose frames a task lays out at a time
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)  # in a double


def _frame_values(values, known, at, windows, hows):
    """``(window, how) -> (result, is NULL)`` of the frames whose rows ``at`` lists, oldest first."""
    rows, here = values[at], known[at]
    plain = np.where(here, rows, 0.0)
    odd = here & np.isnan(rows)
    odd = odd if odd.any() else None
    out = {}
    for w in windows:
        r, h = rows[-w:], here[-w:]
        n = np.add.reduce(h, axis=0, dtype=np.int64)
        least = np.fmin.reduce(r, axis=0) if {"min", "std"} & set(hows) else None
        for how in hows:
            short = n == 0
            if how in ("mean", "sum"):
                v = np.add.reduce(plain[-w:], axis=0)
                v = v / np.maximum(n, 1) if how == "mean" else v
            elif how == "min":
                v = least
            elif how == "max":
                v = np.fmax.reduce(r, axis=0)
                if odd is not None:  # NaN is the largest value
                    v = np.where(odd[-w:].any(axis=0), np.nan, v)
            elif how == "std":
                # Measured from the least value, so equal values deviate by exactly 0.
                d = np.where(h, r - least, 0.0)
                d = np.where(h, d - np.add.reduce(d, axis=0) / np.maximum(n, 1), 0.0)
                v, short = np.sqrt(np.add.reduce(d * d, axis=0) / np.maximum(n - 1, 1)), n < 2
            else:  # median; NULL and NaN stand last in the sorted frame
                line = np.sort(np.ascontiguousarray(r.T), axis=1)
                i = np.arange(len(line))
                v = (0.5 * line[i, np.maximum(n - 1, 0) // 2]
                     + 0.5 * line[i, np.minimum(n // 2, w - 1)])
            out[w, how] = v, short
    return out


def _rolled(targets: dict[str, Sequence[str]], windows: Sequence[int], number: str,
            schema: pa.Schema, only: str | None, batches: Iterator[pa.RecordBatch]
            ) -> Iterator[pa.RecordBatch]:
    """Add the rolling columns to rows in window order; ``number`` counts a group's rows from 0.

    With ``only`` (a flag) frames are laid out for its rows, and the others stop here.
    """
    longest, last = max(windows), -1
    tail = {c: (np.empty(0), np.empty(0, bool)) for c in targets}
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            # Rows of no key have no number and no history.
            pos = batch.column(number).fill_null(0).to_numpy(zero_copy_only=False)
            if not ((pos == 0) | (pos == np.concatenate(([last], pos[:-1])) + 1)).all():
                raise ValueError("rows are not in window order")
            last, made = pos[-1], {}
            before = min((len(v) for v, _ in tail.values()), default=0)
            size = before + len(pos)
            back = np.arange(longest, 0, -1)[:, None]
            asked = np.arange(len(pos)) if only is None else np.flatnonzero(
                batch.column(only).fill_null(False).to_numpy(zero_copy_only=False))
            at = np.where(pos[asked] >= back, before + asked - back, size)
            # One more frame, so that sums never run along a single column in another order.
            at = np.concatenate((at, np.full((longest, 1), size)), axis=1)
            for c, hows in targets.items():
                given = batch.column(c)
                v = np.concatenate((tail[c][0], given.cast(pa.float64()).to_numpy(
                    zero_copy_only=False)))
                k = np.concatenate((tail[c][1], given.is_valid().to_numpy(zero_copy_only=False)))
                tail[c] = v[-longest:], k[-longest:]
                if not len(asked):
                    continue
                with np.errstate(all="ignore"):
                    found = _frame_values(np.append(v, np.nan), np.append(k, False), at,
                                          windows, hows)
                for (w, how), (x, null) in found.items():
                    made[f"{c}_{w}_{how}"] = x[:-1], null[:-1]
            if not len(asked):
                continue
            if only is not None:
                batch = batch.take(pa.array(asked))
            arrays = [_column(*made[f.name], f.type) if f.name in made else batch.column(f.name)
                      for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _column(values, null, kind):
    if pa.types.is_integer(kind):
        values = np.where(null, 0, values).astype(kind.to_pandas_dtype())
    return pa.array(values, mask=null).cast(kind)


def with_rolling(o: OrderedRows, targets=None, windows: Sequence[int] = WINDOWS,
                 df: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """Rows plus the columns of ``rolling``, in one pass over the ordered rows.

    ``only`` names a flag: all rows are read as history, the rows that have it are returned.

    A task lays out the frames of some thousand rows at a time and keeps the longest frame of
    them for the next.  Values that a double does not hold exactly stay with ``rolling``.
    """
    df = o.rows if df is None else df
    if max(windows) > o.halo:
        raise ValueError(f"frame of {max(windows)} rows needs halo >= {max(windows)}")
    targets = {c: hows for c, hows in (targets or ROLLING).items() if c in df.columns}
    kinds = {c: df.schema[c].dataType for c in targets}
    exact = {c: hows for c, hows in targets.items() if isinstance(kinds[c], _EXACT)}
    others = {c: hows for c, hows in targets.items() if c not in exact}
    if others:
        df = df.select("*", *[c.alias(n) for n, c in rolling(o, others, windows).items()])
    if not exact:
        return df if only is None else df.where(F.col(only))

    def kind(c, how):
        whole = isinstance(kinds[c], T.IntegralType)
        if how in ("min", "max"):
            return kinds[c]
        return T.LongType() if how == "sum" and whole else T.DoubleType()
    new = [T.StructField(f"{c}_{w}_{how}", kind(c, how))
           for c, hows in exact.items() for how in hows for w in windows]
    schema = T.StructType([*df.schema.fields, *new])
    numbered = df.select("*", o.over(F.row_number(), o.spec).cast("long").alias("_no"))
    numbered = numbered.withColumn("_no", F.col("_no") - 1)
    # Names and types alone: the other columns pass as they come.
    arrow = pa.schema([(f.name, pa.null()) for f in df.schema.fields]
                      + [(f.name, _ARROW[type(f.dataType)]) for f in new])
    # Shipped by value, so executors need no installed copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def run(batches):
        return _rolled(exact, windows, "_no", arrow, only, batches)
    return numbered.mapInArrow(run, schema)


_ARROW = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(),
          T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}


def category_rates(o: OrderedRows, column: str = "running_style",
                   categories: Sequence[str] = STYLES,
                   windows: Sequence[int] = STYLE_WINDOWS) -> dict[str, Column]:
    """Share of the last rows that fell into each category, 0 without history."""
    hit = {c: F.when(F.col(column) == c, 1).otherwise(0) for c in categories}
    return {f"rate_{c}_{w}": F.coalesce(o.over(F.avg(hit[c]), o.last(w)), F.lit(0.0))
            for c in categories for w in windows}


def suitability_conditions(columns: Sequence[str]) -> dict[str, Column]:
    """Name suffix -> condition of each context the entrant has a record in."""
    out = {}
    if "distance_category" in columns:
        out |= {c: F.col("distance_category") == c for c in DISTANCES}
    if "surface" in columns:
        out |= {name: F.col("surface") == s for s, name in SURFACES.items()}
    if "place" in columns:
        out |= {f"place_{p}": F.col("place") == p for p in PLACES}
    return out


def suitability_terms(conditions: dict[str, Column], value: str = "rank") -> dict[str, Column]:
    """What each row adds to the sum (``_s_``) and the count (``_n_``) of each context."""
    return {f"_s_{n}": F.when(c, F.col(value)).cast("double") for n, c in conditions.items()} | {
        f"_n_{n}": F.when(c & F.col(value).isNotNull(), 1) for n, c in conditions.items()}


def with_suitability(o: OrderedRows, conditions: dict[str, Column] | None = None,
                     value: str = "rank", df: DataFrame | None = None,
                     before: DataFrame | None = None) -> DataFrame:
    """``avg_rank_{context}``: mean of all earlier values in the context, 99 without.

    ``before`` has, per entrant, the totals of ``suitability_terms`` over rows that came before all
    of these and are not among them.
    """
    df = o.rows if df is None else df
    kept = df.columns
    conditions = conditions or suitability_conditions(kept)
    terms = suitability_terms(conditions, value)
    rows = o.running(terms, df)
    total = {t: F.col(t) for t in terms}
    if before is not None:
        rows = rows.join(before.select(*[F.col(k).alias(f"_k_{k}") for k in o.keys],
                                       *[F.col(t).alias(f"_b{t}") for t in terms]),
                         [F.col(k) == F.col(f"_k_{k}") for k in o.keys], "left")
        total = {t: F.coalesce(F.col(t), F.lit(0)) + F.coalesce(F.col(f"_b{t}"), F.lit(0))
                 for t in terms}
    return rows.select(*kept, *[
        F.coalesce(F.try_divide(total[f"_s_{n}"], total[f"_n_{n}"]), F.lit(float(NO_RANK)))
        .alias(f"avg_{value}_{n}") for n in conditions])


def decay_block(span: int) -> int:
    """Rows whose weight falls from 1 to ``BLOCK_WEIGHT``."""
    return math.ceil(math.log(BLOCK_WEIGHT) / math.log(1 - 2 / (span + 1)))


def decay_rows(span: int) -> int:
    """Steps back beyond which a weight is below the smallest double."""
    return 2 * decay_block(span)


def with_decayed_means(o: OrderedRows, values: dict[str, str], span: int = 5,
                       df: DataFrame | None = None) -> DataFrame:
    """Exponentially weighted mean of all earlier rows; ``values`` maps name -> column.

    Each step back weighs (1 - 2/(span+1)) as much and NULLs keep their age.  Rows are taken
    in blocks; inside a block the weights are relative to its start, so plain running sums
    do, and the sums of the two blocks before are added with the weight of the distance.
    Older blocks weigh less than a double can tell from nothing.  A run of NULLs leaves the
    mean unchanged, so it is computed at rows with a value and carried forward.
    """
    df = o.rows if df is None else df
    keep, size = 1 - 2 / (span + 1), decay_block(span)
    if o.hot is not None and o.halo < decay_rows(span):
        raise ValueError(f"span {span} needs halo >= {decay_rows(span)}")
    inside = Window.partitionBy(*o.group, "_block").orderBy(*nulls_last(o.order)).rowsBetween(
        Window.unboundedPreceding, 0)
    by_block = Window.partitionBy(*o.group).orderBy("_block")
    number = F.row_number().over(o.spec) - 1
    blocks = df.select("*", number.alias("_rn")).withColumns({
        "_block": F.floor(F.col("_rn") / size),
        "_scale": F.pow(F.lit(1 / keep), F.pmod(F.col("_rn"), F.lit(size)))})

    def total(term):
        earlier = [F.coalesce(F.sum(term).over(by_block.rangeBetween(-k, -k)), F.lit(0.0))
                   for k in (1, 2)]
        # The nearer block first: no product leaves the range of a double.
        return F.coalesce(F.sum(term).over(inside), F.lit(0.0)) + F.lit(keep ** size) * (
            earlier[0] + F.lit(keep ** size) * earlier[1])

    at_value = blocks.select(*df.columns, *[
        F.when(known, total(F.col(c) * F.col("_scale")) / total(F.when(known, F.col("_scale"))))
        .alias(f"_at_{n}") for n, c in values.items() for known in [F.col(c).isNotNull()]])
    return o.latest({n: F.col(f"_at_{n}") for n in values}, at_value).drop(
        *[f"_at_{n}" for n in values])


def position_columns(order: str = "passing_order") -> dict[str, Column]:
    first, final = S.first_position(order), S.final_position(order)
    return {"first_corner_pos": first, "final_corner_pos": final,
            "position_gain": final - first}


#: What the columns of ``with_history`` are made of, besides the entrant and the order.
SOURCES = ("rank", "prize", "agari_3f", "odds", "popularity", "weight", "horse_weight",
           "passing_order", "running_style", "jockey_id", "age")


def with_history(df: DataFrame, *, agent: str | None = "jockey_id", date: str = DATE,
                 entrant: str = ENTRANT, tiebreak: Sequence[str] = TIEBREAK,
                 before: DataFrame | None = None, wanted: Sequence[str] | None = None,
                 only: str | None = None, **skew) -> DataFrame:
    """All entrant history columns.  One shuffle by entrant serves every window.

    ``before``: totals of older rows that are not here, as in ``with_suitability``.
    ``wanted``: only those of the columns that are listed; the others are not computed.
    ``only``: a flag of the rows to return, as in ``with_rolling``.
    """
    if "passing_order" in df.columns:
        df = df.withColumns(position_columns())

    def asked(name):
        return wanted is None or name in wanted
    o = entrant_rows(df, entrant, date, tiebreak, **skew)
    month_sin, month_cos = S.month_cycle(date)
    lagged = lags(o)
    new = {"interval": day_gap(o, date), "month_sin": month_sin, "month_cos": month_cos} | lagged
    rolled = [n for n in rolling(o) if asked(n)]
    styles = {}
    if agent and agent in df.columns:
        styles["same_jockey"] = same_as_last(o, agent)
    if "running_style" in df.columns:
        styles |= category_rates(o)
    new, styles = ({n: c for n, c in x.items() if asked(n)} for x in (new, styles))
    wide = o.rows.select("*", *[c.alias(n) for n, c in (new | styles).items()])
    conditions = {n: c for n, c in suitability_conditions(wide.columns).items()
                  if asked(f"avg_rank_{n}")}
    known = with_suitability(o, conditions, df=wide, before=before) if conditions else wide
    # Rolling columns come last: no window behind them needs the rows moved again.
    out = known if only is None or rolled else known.where(F.col(only))
    if rolled:
        used = {c: [how for how in hows if any(f"{c}_{w}_{how}" in rolled for w in WINDOWS)]
                for c, hows in ROLLING.items()}
        out = with_rolling(o, {c: hows for c, hows in used.items() if hows},
                           [w for w in WINDOWS if any(f"_{w}_" in n for n in rolled)], df=known,
                           only=only)
    momentum = ["rank_momentum_5"] if asked("rank_momentum_5") else []
    if momentum:
        out = out.withColumn("rank_momentum_5", F.col("rank_5_mean") - F.col("prev_rank"))
    order = [*o.rows.columns, *new, *rolled, *styles, *momentum,
             *known.columns[len(wide.columns):]]
    return o.finish(out.select(*order))


def vendor_history(df: DataFrame, entrant: str = "horse_id_jv", date: str = "date_jv",
                   number: str = "レース番号", **skew) -> DataFrame:
    """Vendor figures of the entrant's previous race.

    Rows of one date and number are ordered by their figures, so the result is the same
    whatever the order of the input.
    """
    figures = [c for c in VENDOR_LAGS if c in df.columns]
    o = OrderedRows(df, [entrant], [date, number, *figures], halo=1, **skew)
    new = {name: o.over(F.lag(F.col(f"`{c}`"), 1), o.spec)
           for c, name in VENDOR_LAGS.items() if c in df.columns}
    return o.finish(o.rows.select("*", *[c.alias(n) for n, c in new.items()]))


def with_baseline_history(df: DataFrame, **skew) -> DataFrame:
    """The smaller first-generation history: means over 5, decayed means, previous values."""
    o = entrant_rows(df, halo=max(LONGEST, decay_rows(5)), **skew)

    def mean5(c):
        return o.over(F.avg(c), o.last(5))

    def previous(c):
        return o.over(F.lag(c, 1), o.spec)

    plain = o.rows.select(
        "*",
        F.coalesce(previous("rank"), F.lit(NO_RANK)).alias("prev_rank"),
        F.coalesce(mean5("rank"), F.lit(float(NO_RANK))).alias("avg_rank_5"),
        F.coalesce(previous("prize"), F.lit(0.0)).alias("prev_prize"),
        F.coalesce(previous("time_seconds"), F.lit(0.0)).alias("prev_time_seconds"),
        F.coalesce(previous("odds"), F.lit(0.0)).alias("prev_odds"),
        F.coalesce(mean5("weight_change"), F.lit(0.0)).alias("avg_weight_change_5"),
    )
    decayed = with_decayed_means(o, {"ewma_rank_5": "rank", "ewma_prize_5": "prize"}, df=plain)
    surfaces = {name: F.col("surface") == s for s, name in SURFACES.items()}
    out = o.finish(with_suitability(o, surfaces, df=decayed))
    return out.withColumns({
        "ewma_rank_5": F.coalesce("ewma_rank_5", F.lit(float(NO_RANK))),
        "ewma_prize_5": F.coalesce("ewma_prize_5", F.lit(0.0)),
    })
