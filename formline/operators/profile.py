"""Profiles of tables, keys and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.session import park
from formline.skew import global_running

# Upper bin edges (a, b] and labels of the vendor figures.
BINS = {
    "PCI": ((40, 45, 50, 55, 60), ("~40", "40-45", "45-50", "50-55", "55-60", "60~")),
    "補正タイム": ((90, 95, 100, 105, 110),
               ("~90", "90-95", "95-100", "100-105", "105-110", "110~")),
    "増減": ((-20, -10, -4, 0, 4, 10, 20),
           ("大幅減(-20~)", "-20~-10", "-10~-4", "-4~0", "0~4", "4~10", "10~20",
            "大幅増(20~)")),
    "-3F差": ((-1.0, -0.5, 0, 0.5, 1.0),
            ("大幅速(-1.0~)", "-1.0~-0.5", "-0.5~0", "0~0.5", "0.5~1.0", "遅(1.0~)")),
}
MINIMUM_PAIRS = 10_000  # correlations need more rows than this


def valid_positions(df: DataFrame, position: str = "rank") -> DataFrame:
    return df.where(F.col(position) > 0)


def rate_profile(df: DataFrame, key: str | Column, name: str, position: str = "rank",
                 price: str = "odds") -> DataFrame:
    """Per key: wins, rows, win rate, mean price and the simple recovery."""
    win = F.when(F.col(position) == 1, 1).otherwise(0)
    sums = df.withColumn(name, S.col(key)).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.sum(win).alias("wins"), F.count("*").alias("n"), F.avg(win).alias("win_rate"),
        F.avg(price).alias("mean_price"))
    return sums.withColumn("simple_recovery", F.col("win_rate") * F.col("mean_price") * 100)


def top_by(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in order; each task keeps only its own first ``n``."""
    return df.orderBy(*order).limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """Missing share, distinct values and type of every column.

    Values are counted per (column, value) before any column total, so the distinct counts
    are exact and no task holds a column's value set.
    """
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"),
                               F.col(f"`{f.name}`").cast("string").alias("value"))
                      for f in df.schema])
    values = df.select(F.explode(pairs).alias("_p")).groupBy("_p.column", "_p.value").agg(
        F.count("*").alias("rows"))
    known = F.col("value").isNotNull()
    per = values.groupBy("column").agg(
        F.sum("rows").alias("n"), F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("missing"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return per.select("column", (F.col("missing") / F.col("n") * 100).alias("missing_pct"),
                      "distinct_values", S.lookup("column", kinds).alias("kind"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, standard deviation and missing share of each column, in one pass."""
    aggs = df.agg(F.count("*").alias("_n"), *[
        F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"),
                 F.stddev_samp(c).alias("std"),
                 F.avg(F.col(c).isNull().cast("double")).alias("missing")).alias(f"_{i}")
        for i, c in enumerate(columns)])
    return aggs.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))]))
                       .alias("_s")).select("_s.*")


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("rows"))
    return top_by(counts, [F.desc("rows"), F.asc("value")], n)


def correlations(df: DataFrame, columns: Sequence[str], position: str = "rank",
                 minimum: int = MINIMUM_PAIRS) -> DataFrame:
    """Correlation of each column with the position and with winning, in one aggregation."""
    rank = F.col(position).cast("double")
    win = F.when(F.col(position) == 1, 1.0).otherwise(0.0)
    aggs = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("known"),
        F.corr(rank, F.col(c).cast("double")).alias("with_rank"),
        F.corr(win, F.col(c).cast("double")).alias("with_win")).alias(f"_{i}")
        for i, c in enumerate(columns)])
    rows = aggs.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))]))
                       .alias("_s")).select("_s.*")
    return rows.where(F.col("known") > minimum).orderBy(F.desc(F.abs("with_win")))


def numeric_quality(df: DataFrame, column: str) -> DataFrame:
    """Rows, missing (also unreadable), zero and unreadable values of a numeric text."""
    x, raw = S.number(column), F.col(column)
    return df.agg(
        F.count("*").alias("n"), F.count(F.when(x.isNull(), 1)).alias("missing"),
        F.count(F.when(x == 0, 1)).alias("zeros"),
        F.count(F.when(raw.isNotNull() & x.isNull(), 1)).alias("unreadable"))


def date_overlap(first: DataFrame, second: DataFrame, date1: str, date2: str) -> DataFrame:
    """First/last date of both sources, the shared period and the share of rows in it.

    Rows are reduced to counts per date before the shared period is known.
    """
    def per_date(df, date, source):
        return df.select(F.lit(source).alias("source"), F.col(date).cast("date").alias("d")) \
            .groupBy("source", "d").agg(F.count("*").alias("rows"))

    dates = per_date(first, date1, 1).unionByName(per_date(second, date2, 2))
    one, two, d = F.col("source") == 1, F.col("source") == 2, F.col("d")
    everything = Window.partitionBy(F.lit(1))  # one row per source and calendar day
    lo = F.greatest(F.min(F.when(one, d)).over(everything), F.min(F.when(two, d)).over(everything))
    hi = F.least(F.max(F.when(one, d)).over(everything), F.max(F.when(two, d)).over(everything))
    spans = dates.withColumns({"overlap_start": lo, "overlap_end": hi})
    inside = d.between(F.col("overlap_start"), F.col("overlap_end"))
    return spans.groupBy("source", "overlap_start", "overlap_end").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"),
        F.sum("rows").alias("n"),
        F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0)).alias("n_inside")
    ).withColumn("share_inside", F.col("n_inside") / F.col("n") * 100)


def length_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.length(F.col(column)).alias("length")).agg(F.count("*").alias("rows"))


def key_overlap(first: DataFrame, second: DataFrame, key1: str, key2: str) -> DataFrame:
    """Distinct keys of both sources, common ones and the match rate of the first."""
    keys = (
        first.select(F.col(key1).cast("string").alias("k"), F.lit(1).alias("a"),
                     F.lit(0).alias("b"))
        .unionByName(second.select(F.col(key2).cast("string").alias("k"), F.lit(0).alias("a"),
                                   F.lit(1).alias("b")))
        .where(F.col("k").isNotNull()).groupBy("k").agg(F.max("a").alias("a"),
                                                        F.max("b").alias("b")))
    return keys.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("first_keys"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("second_keys"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("common_keys"),
    ).withColumn("match_rate",
                 F.coalesce(F.try_divide("common_keys", "first_keys"), F.lit(0.0)) * 100)


def common_keys(first: DataFrame, second: DataFrame, key1: str, key2: str) -> DataFrame:
    return first.select(F.col(key1).cast("string").alias("key")).intersect(
        second.select(F.col(key2).cast("string").alias("key")))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """Exact interpolated median without holding all values in one task.

    Equal values are counted first; the distinct ones are then ranked range by range.
    """
    values = park(df.where(F.col(column).isNotNull()).groupBy(
        F.col(column).cast("double").alias("v")).agg(F.count("*").alias("m")), "values")
    n = values.agg(F.sum("m")).first()[0]
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("median"))
    low, high = (n - 1) // 2, n // 2  # zero-based ranks of the two middle values
    ranked = global_running(values, ["v"], {"below": F.col("m")})

    def at(rank):
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("m")),
                            F.col("v")))

    return ranked.agg(((at(F.lit(low)) + at(F.lit(high))) / 2).alias("median"))


def probability_sums(preds: DataFrame, contest: str = "race_id",
                     prob: str = "pred_prob") -> DataFrame:
    """Mean, median, least and greatest of the per-contest probability sums."""
    sums = park(preds.groupBy(contest).agg(F.sum(prob).alias("s")), "contest-sums")
    rest = sums.agg(F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"))
    middle = exact_median(sums, "s").first()["median"]
    return rest.withColumn("median", F.lit(middle).cast("double"))


def ordered_cut(df: DataFrame, date: str, share: float = 0.8) -> DataFrame:
    """Last date of the leading ``share`` of the rows, in date order.

    Rows are counted per calendar date, so the running count covers only dates.
    """
    days = df.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("d")).agg(
        F.count("*").alias("m"))
    upto = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    run = days.select("d", F.sum("m").over(upto).alias("upto"),
                      F.sum("m").over(everything).alias("n"))
    return run.agg(F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("d"))).alias("cut"))
