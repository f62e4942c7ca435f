"""Per-key windows and statistics that stay bounded when one key is very large.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Here the row
count of each key is checked first (one column, partially aggregated before the shuffle):

* no key above the limit: the plain window is used as is;
* some keys above it: only their rows are cut into consecutive slices of ``slice_rows``
  rows.  Bounded frames read a halo copied from the slice before; running totals add a
  carry summed over the earlier slices.  Results are the same row for row.  Rows are
  numbered by one window if no key exceeds ``WHOLE_ROWS``, else range by range.

Tables of more than ``TASK_VALUES`` values (rows times columns) a core are dealt to as many
tasks as keep each near that number, whatever the number of shuffle partitions.

Rows with a NULL key belong to no group; they are spread over many slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.session import park

HOT_ROWS = 2_000_000
SLICE_ROWS = 1_000_000
WHOLE_ROWS = HOT_ROWS  # rows of a key that one window still numbers
TASK_VALUES = 2_000_000
MAX_PIECES = 4096
MAX_LEVELS, PIECE_BASE = 4, 16_384  # four levels of up to 2 * MAX_PIECES ranges fit a long
BROADCAST_ROWS = 200_000

_SLICE, _HALO, _PIECE, _LEAD, _RN = "_slice", "_halo", "_piece", "_lead", "_rn"
_SPREAD, _KEY_ROWS = "_spread", "_key_rows"


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def counted_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS
                 ) -> tuple[DataFrame | None, int]:
    """``hot_keys`` and the number of rows of ``df``, from one pass over the keys."""
    counts = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    known = ~any_null(keys)
    total, most = counts.agg(F.sum("_n"), F.max(F.when(known, F.col("_n")))).first()
    found = most is not None and most > limit
    return (park(counts.where(known & (F.col("_n") > limit)), "hot-keys") if found else None,
            total or 0)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows and their row count ``_n``; None if there are none.

    The table has at most rows/limit rows.
    """
    return counted_keys(df, keys, limit)[0]


def dealt(df: DataFrame, group: Sequence[str], rows: int | None) -> DataFrame:
    """Rows laid out by ``group`` in tasks of some ``TASK_VALUES`` values; a small table is left
    to Spark."""
    tasks = math.ceil((rows or 0) * len(df.columns) / TASK_VALUES)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, *group)


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``small`` only if its counted size allows it; else Spark shuffles."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


TEXT_CHUNKS, CHUNK = 3, 6


def order_numbers(df: DataFrame, columns: Sequence[str]) -> list[tuple[Column, bool]]:
    """Doubles that order rows as ``columns`` do, coarse to fine; NaN stands for NULL.

    Equal numbers mean equal values up to the last one of the list.  The flag tells whether
    NaN, too, means one value (a floating column also has NaN of its own).
    """
    out: list[tuple[Column, bool]] = []
    for name in columns:
        c, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, T.TimestampNTZType):
            # Wall-clock parts, so the session time zone plays no role.
            second = F.hour(c) * 3600 + F.minute(c) * 60 + F.expr(
                f"extract(SECOND FROM `{name}`)").cast("double")
            parts = [F.datediff(c.cast("date"), F.lit("1970-01-01")), second]
        elif isinstance(kind, T.DateType):
            parts = [F.datediff(c, F.lit("1970-01-01"))]
        elif isinstance(kind, (T.LongType, T.TimestampType)):
            # Both halves are exact as doubles.
            whole = c if isinstance(kind, T.LongType) else F.unix_micros(c)
            parts = [F.shiftright(whole, 32), whole.bitwiseAND(F.lit(2**32 - 1))]
        elif isinstance(kind, T.StringType):
            hexes = F.hex(F.encode(c, "UTF-8"))
            parts = [F.conv(F.rpad(F.substring(hexes, 1 + 2 * CHUNK * i, 2 * CHUNK), 2 * CHUNK,
                                   "0"), 16, 10) for i in range(TEXT_CHUNKS)]
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            parts = [c]
        else:
            return out
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        out += [(F.coalesce(p.cast("double"), F.lit(float("nan"))), not floating) for p in parts]
        if isinstance(kind, (T.DecimalType, T.StringType)):
            return out  # different values may share all their numbers
    return out


def pieces(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """Add ``_piece``: ranges of the row order with about equally many rows.

    Ranges are cut at quantiles of the first order number.  A value so frequent that it
    fills whole ranges is kept apart, and its rows are cut by the next number.
    """
    count = max(2, min(MAX_PIECES, count))
    kept = df.columns
    df = df.withColumn(_PIECE, F.lit(0).cast("long"))
    is_open = F.lit(True)  # rows still to be cut
    for number, nan_is_null in order_numbers(df, order)[:MAX_LEVELS]:
        df = df.withColumn(_LEAD, F.when(is_open, number).otherwise(F.lit(float("nan"))))
        known = df.where(is_open & ~F.isnan(_LEAD))
        cuts = known.approxQuantile(_LEAD, [i / count for i in range(1, count)], 0.25 / count)
        frequent = sorted({c for c in cuts if cuts.count(c) > 1 and math.isfinite(c)})
        inner = {c for c in cuts if math.isfinite(c)} | {
            math.nextafter(c, math.inf) for c in frequent}
        splits = [-math.inf, *(sorted(inner) or [0.0]), math.inf]
        df = Bucketizer(splits=splits, inputCol=_LEAD, outputCol="_bucket",
                        handleInvalid="keep").transform(df)
        bucket = F.when(is_open, F.col("_bucket").cast("long")).otherwise(F.lit(0))
        repeated = F.col(_LEAD).isin(frequent) if frequent else F.lit(False)
        if nan_is_null:
            repeated = repeated | F.isnan(_LEAD)
        df = df.select(*kept, (F.col(_PIECE) * PIECE_BASE + bucket).alias(_PIECE),
                       (is_open & repeated).alias("_open"))
        if not frequent and (cuts or not nan_is_null):
            break
        is_open = F.col("_open")
    return df.drop("_open")


class OrderedRows:
    """Rows laid out for windows ordered within ``keys``.

    ``order`` names the ordering columns (ascending); the first one drives the slicing.
    ``halo`` is the longest bounded frame, in rows, that will be used.  ``rows`` is the number
    of rows, needed only where ``hot`` is given.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 halo: int = 0, hot_rows: int | None = None, slice_rows: int | None = None,
                 hot: DataFrame | None | str = "check", rows: int | None = None,
                 whole_rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.halo = halo
        self._frames, self._has_key = {}, ~any_null(keys)
        hot_rows = HOT_ROWS if hot_rows is None else hot_rows
        self.slice_rows = max(SLICE_ROWS if slice_rows is None else slice_rows, halo, 1)
        self.hot, total = counted_keys(df, self.keys, hot_rows) if isinstance(hot, str) else (
            hot, rows)
        spread = -1 - F.pmod(F.xxhash64(*self.order), F.lit(4096)).cast("long")
        slice_of = F.when(any_null(self.keys), spread).otherwise(F.lit(0).cast("long"))
        if self.hot is None:
            # Without NULL keys the slice is a constant, which Spark drops from the windows' keys.
            nulls = any(df.schema[k].nullable for k in self.keys)
            self.rows = dealt(df.withColumn(_SLICE, slice_of),
                              self.group if nulls else self.keys, total)
            return
        count, hot_total, most = self.hot.agg(F.count("*"), F.sum("_n"), F.max("_n")).first()
        self._one_slice = most <= self.slice_rows
        names = self._hot_names = bounded(self.hot.select(*self.keys), count)
        sizes = bounded(self.hot.select(*self.keys, F.col("_n").alias(_KEY_ROWS)), count)
        if most <= (WHOLE_ROWS if whole_rows is None else whole_rows):
            group = [*self.keys, _SPREAD]
            inside = Window.partitionBy(*group).orderBy(*nulls_last(self.order))
            both = dealt(df.join(sizes, self.keys, "left").withColumn(_SPREAD, slice_of), group,
                         total).withColumn(_RN, F.row_number().over(inside))
            cut = self._sliced(both, F.col(_RN) - 1, F.col(_SPREAD))
            kept = cut.select(*df.columns, _SLICE, _HALO)
        else:
            cold = df.join(names, self.keys, "left_anti").select(
                *df.columns, slice_of.alias(_SLICE), F.lit(False).alias(_HALO))
            big = self._cut(df.join(sizes, self.keys), hot_total)
            kept = cold.unionByName(big.select(*cold.columns))
        self.rows = dealt(kept, self.group, total)

    def _cut(self, big: DataFrame, total: int) -> DataFrame:
        """Number the rows of the hot keys range by range and cut them into slices."""
        count = 2 * math.ceil(total / self.slice_rows)
        big = pieces(big, self.order, count)
        group = [*self.keys, _PIECE]
        before = Window.partitionBy(*self.keys).orderBy(_PIECE).rowsBetween(
            Window.unboundedPreceding, -1)
        starts = big.groupBy(*group).agg(F.count("*").alias("_m")).select(
            *group, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
        inside = Window.partitionBy(*group).orderBy(*nulls_last(self.order))
        ranked = big.withColumn(_RN, F.row_number().over(inside)).join(starts, group)
        return self._sliced(ranked, F.col("_start") + F.col(_RN) - 1, F.lit(0).cast("long"))

    def _sliced(self, df: DataFrame, zero_based: Column, otherwise: Column) -> DataFrame:
        """Put rows of hot keys into slices; the last ones also head the next slice, if any."""
        size = F.lit(self.slice_rows)
        hot = F.col(_KEY_ROWS).isNotNull()
        own = F.when(hot, F.floor(zero_based / size).cast("long")).otherwise(otherwise)
        heads_next = (hot & (F.pmod(zero_based, size) >= size - self.halo)
                      & ((own + 1) * size < F.col(_KEY_ROWS)))
        def place(at, halo):
            return F.struct(at.alias(_SLICE), F.lit(halo).alias(_HALO))

        here = place(own, False)
        targets = F.when(heads_next, F.array(here, place(own + 1, True))).otherwise(F.array(here))
        return df.withColumn("_place", F.explode(targets)).select(
            *df.columns, F.col(f"_place.{_SLICE}"), F.col(f"_place.{_HALO}"))

    @property
    def group(self) -> list[str]:
        """Columns that hold the rows a window may see together."""
        return [*self.keys, _SLICE]

    @cached_property
    def spec(self):
        return Window.partitionBy(*self.group).orderBy(*nulls_last(self.order))

    def last(self, rows: int):
        """Frame over the ``rows`` rows before the current one."""
        if rows > self.halo:
            raise ValueError(f"frame of {rows} rows needs halo >= {rows}")
        if rows not in self._frames:
            self._frames[rows] = self.spec.rowsBetween(-rows, -1)
        return self._frames[rows]

    def over(self, value: Column, frame) -> Column:
        """``value`` over ``frame``; NULL on rows whose key is NULL."""
        return F.when(self._has_key, value.over(frame))

    @cached_property
    def before(self):
        """Frame over all earlier rows of the slice; combine with ``totals``."""
        return self.spec.rowsBetween(Window.unboundedPreceding, -1)

    @cached_property
    def own(self) -> Column:
        """True on rows that are not halo copies."""
        return F.lit(True) if self.hot is None else ~F.col(_HALO)

    def _carried(self, df: DataFrame, per_slice: dict[str, Column], across) -> DataFrame:
        """One row per slice of the hot keys: ``across`` over the earlier slices."""
        group = self.group
        earlier = Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(
            Window.unboundedPreceding, -1)
        return (
            df.where(~F.col(_HALO)).join(self._hot_names, self.keys, "left_semi")
            .groupBy(*group).agg(*[v.alias(f"_c_{n}") for n, v in per_slice.items()])
            .select(*group, *[across(F.col(f"_c_{n}")).over(earlier).alias(f"_c_{n}")
                              for n in per_slice])
        )

    def running(self, values: dict[str, Column], df: DataFrame | None = None) -> DataFrame:
        """Rows plus, for each named value, its sum over all earlier rows of the key
        (NULL until the first non-NULL value)."""
        df = self.rows if df is None else df
        kept = df.columns
        local = df.select("*", *[
            self.over(F.sum(F.when(self.own, v)), self.before).alias(n)
            for n, v in values.items()])
        if self.hot is None or self._one_slice:
            return local
        carry = self._carried(df, {n: F.sum(v) for n, v in values.items()}, F.sum)

        def plus(name):
            a, b = F.col(name), F.col(f"_c_{name}")
            return F.when(a.isNotNull() | b.isNotNull(),
                          F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

        return local.join(carry, self.group, "left").select(
            *kept, *[plus(n).alias(n) for n in values])

    def latest(self, values: dict[str, Column], df: DataFrame | None = None) -> DataFrame:
        """Rows plus, for each named value, its last non-NULL among the earlier rows."""
        df = self.rows if df is None else df
        kept = df.columns
        local = df.select("*", *[
            self.over(F.last(F.when(self.own, v), ignorenulls=True), self.before).alias(n)
            for n, v in values.items()])
        if self.hot is None or self._one_slice:
            return local
        place = F.struct(*[x for c in self.order for x in
                           (F.col(c).isNull().alias(f"null_{c}"), F.col(c))])
        carry = self._carried(
            df, {n: F.max_by(v, F.when(v.isNotNull(), place)) for n, v in values.items()},
            lambda c: F.last(c, ignorenulls=True))
        return local.join(carry, self.group, "left").select(
            *kept, *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in values])

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns."""
        if self.hot is not None:
            df = df.where(~F.col(_HALO))
        return df.drop(_SLICE, _HALO)


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], *,
                     hot_rows: int | None = None,
                     hot: DataFrame | None | str = "check", rows: int | None = None) -> DataFrame:
    """Add aggregates of each key's rows to every row (NULL for NULL keys).

    Keys of bounded size use one unordered window.  Hot keys are aggregated map-side and
    their few result rows joined back, so no task ever holds a hot group.
    """
    keys = list(keys)
    hot, total = counted_keys(df, keys, HOT_ROWS if hot_rows is None else hot_rows) \
        if isinstance(hot, str) else (hot, rows)
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)][:8]
    spread = F.when(any_null(keys), F.pmod(F.xxhash64(*hashable), F.lit(4096)))
    w = Window.partitionBy(*keys, _SLICE)
    null_key = any_null(keys)

    def windowed(plain):
        return dealt(plain.withColumn(_SLICE, spread), [*keys, _SLICE], total).select(
            *plain.columns,
            *[F.when(~null_key, agg.over(w)).alias(name) for name, agg in stats.items()])

    if hot is None:
        return windowed(df)
    count = hot.count()
    names = bounded(hot.select(*keys), count)
    big = df.join(names, keys, "left_semi")
    totals = big.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    joined = big.join(bounded(totals, count), keys)
    cold = windowed(df.join(names, keys, "left_anti").select(*df.columns))
    return cold.unionByName(joined.select(*cold.columns))


def global_running(df: DataFrame, order: Sequence[str], values: dict[str, Column], *,
                   piece_rows: int = 250_000, total: int | None = None) -> DataFrame:
    """Sums over all earlier rows of the whole table, in ``order``, without one big sort task.

    Rows are split into ranges of the first ordering column; only the per-range totals
    (at most ``MAX_PIECES`` rows) meet in a single window.
    """
    total = df.count() if total is None else total
    rows = pieces(df, order, math.ceil(max(total, 1) / piece_rows))
    inside = Window.partitionBy(_PIECE).orderBy(*nulls_last(order)).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(1)).orderBy(_PIECE).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = rows.groupBy(_PIECE).agg(*[F.sum(v).alias(f"_c_{n}") for n, v in values.items()])
    carry = sums.select(_PIECE, *[F.coalesce(F.sum(f"_c_{n}").over(across), F.lit(0))
                                  .alias(f"_c_{n}") for n in values])
    local = rows.select(*df.columns, _PIECE, *[
        F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in values.items()])
    return local.join(F.broadcast(carry), _PIECE).select(
        *df.columns, *[(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in values])
