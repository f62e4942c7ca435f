"""Joins that bring a second source to the contest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.skew import bounded, hot_keys

PEDIGREE = ("horse_id", "sire_name", "sire_id", "dam_name", "dam_id", "bms_name", "bms_id",
            "owner_name", "owner_id", "breeder_name", "breeder_id", "production_area")

SAME_NAME = "_jv_dup"  # fixed value: suffix of joined columns whose name is taken
GROUP_ROWS = 2000  # right rows of a key that may meet in one array


def place_of(order: Sequence[str]) -> Column:
    """Comparable struct; rows with a missing ordering value count as latest."""
    return F.struct(*[x for c in order
                      for x in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the first row in ``order``.

    An aggregate with partial results per task, so a key of any size is fine.
    """
    packed = F.min_by(F.struct(*values), place_of(order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def latest_known(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 values: Sequence[str]) -> DataFrame:
    """One row per key: for each column its last non-NULL value in ``order``."""
    place = place_of(order)
    return df.groupBy(*keys).agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(v) for v in values])


def with_dimension(df: DataFrame, dimension: DataFrame | None, key: str = "horse_id",
                   columns: Sequence[str] = PEDIGREE) -> DataFrame:
    """Left join of the entrant dimension; the table itself when there is none.

    No hint: Catalyst broadcasts a dimension whose size allows it.
    """
    if dimension is None:
        return df
    wanted = [c for c in columns if c in dimension.columns]
    dim = dimension.select(*wanted).withColumn(key, S.canonical_id(key))
    return df.withColumn(key, S.canonical_id(key)).join(dim, key, "left")


def with_exact_match(df: DataFrame, other: DataFrame, pairs: dict[str, str],
                     values: Sequence[str], order: Sequence[str],
                     suffix: str = SAME_NAME) -> DataFrame:
    """Left equi-join on several keys (left name -> right name); NULL keys never match.

    A value column that the left table has, too, is added under its name plus ``suffix``.
    """
    right = first_per_key(other, list(pairs.values()), order, values)
    taken = set(df.columns)
    right = right.select(*[F.col(r).alias(f"_k_{r}") for r in pairs.values()], *[
        F.col(v).alias(v + suffix if v in taken else v) for v in values])
    match = S.all_of(*[F.col(a) == F.col(f"_k_{b}") for a, b in pairs.items()])
    return df.join(right, match, "left").drop(*[f"_k_{b}" for b in pairs.values()])


def with_two_tier_match(df: DataFrame, other: DataFrame, exact: dict[str, str],
                        coarse: dict[str, str], values: Sequence[str], order: Sequence[str],
                        group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact match first; rows without one fall back to the coarse keys.

    ``match_tier`` tells how: exact, coarse or none.  Neither tier can multiply rows.

    Both sides move once, by the key pairs that the two tiers share: the right rows of such a key
    are one array, in which each left row looks up its exact and its coarse match.  Keys
    with more than ``group_rows`` right rows are counted first; they, and tiers without a
    shared pair, take a join per tier.  Rows with a NULL key match nothing.
    """
    shared = {a: b for a, b in exact.items() if coarse.get(a) == b}
    if not shared:
        return _tier_by_tier(df, other, exact, coarse, values, order)
    rights = list(shared.values())
    hot = hot_keys(other, rights, group_rows)
    if hot is None:
        return _tiers_at_once(df, other, shared, exact, coarse, values, order)
    names = bounded(hot.select(*[F.col(b).alias(f"_h_{b}") for b in rights]), hot.count())

    def at(keys):
        return S.all_of(*[F.col(k) == F.col(f"_h_{b}") for k, b in zip(keys, rights, strict=True)])

    large = _tier_by_tier(df.join(names, at(shared), "left_semi"),
                          other.join(names, at(rights), "left_semi"), exact, coarse, values, order)
    return _tiers_at_once(df.join(names, at(shared), "left_anti"),
                          other.join(names, at(rights), "left_anti"), shared, exact, coarse,
                          values, order).unionByName(large)


def _tiers_at_once(df, other, shared, exact, coarse, values, order) -> DataFrame:
    own = {tier: {a: b for a, b in keys.items() if a not in shared}
           for tier, keys in (("exact", exact), ("coarse", coarse))}
    rows, rights = "_tier_rows", list(shared.values())
    # A value that also orders the rows is kept once.
    fields = list(dict.fromkeys([*order, *values]))
    entry = F.struct(*[F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(keys.values())],
                                F.lit(True).alias("known")).alias(tier)
                       for tier, keys in own.items()],
                     *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fields)])
    at = {c: f"f{i}" for i, c in enumerate(fields)}
    grouped = other.where(S.all_of(*[F.col(b).isNotNull() for b in rights])).groupBy(
        *[F.col(b).alias(f"_k_{b}") for b in rights]).agg(F.collect_list(entry).alias(rows))
    joined = df.join(grouped, S.all_of(*[F.col(a) == F.col(f"_k_{b}")
                                         for a, b in shared.items()]), "left")

    def first(tier):
        """The row of the first place among those that match the tier's own keys."""
        def fits(x):
            return S.all_of(x[tier]["known"], *[x[tier][f"k{i}"] == F.col(a)
                                                for i, a in enumerate(own[tier])])
        found = F.filter(rows, fits)
        best = F.array_min(F.transform(found, lambda x, i: F.struct(F.struct(*[
            y for n, c in enumerate(order) for y in (
                x[at[c]].isNull().alias(f"null_{n}"), x[at[c]].alias(f"o{n}"))]).alias("place"),
            i.alias("i"))))
        row = F.try_element_at(found, best["i"] + 1)
        return F.when(row.isNotNull(), F.struct(*[row[at[v]].alias(v) for v in values]))

    return _best_tier(joined.select(*df.columns, first("exact").alias("_exact"),
                                    first("coarse").alias("_coarse")), df, values)


def _tier_by_tier(df, other, exact, coarse, values, order) -> DataFrame:
    packed = F.struct(*values)
    out = with_exact_match(df, other.withColumn("_exact", packed), exact, ["_exact"], order)
    out = with_exact_match(out, other.withColumn("_coarse", packed), coarse, ["_coarse"], order)
    return _best_tier(out, df, values)


def _best_tier(out: DataFrame, df: DataFrame, values: Sequence[str]) -> DataFrame:
    best = F.coalesce("_exact", "_coarse")
    tier = (F.when(F.col("_exact").isNotNull(), "exact")
            .when(F.col("_coarse").isNotNull(), "coarse").otherwise("none"))
    taken = set(df.columns)
    return out.select(*df.columns, *[best[v].alias(v + SAME_NAME if v in taken else v)
                                     for v in values], tier.alias("match_tier"))


def match_rate(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, matched rows and matched share, in all or per key."""
    known = F.col(column).isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(column).alias("matched"),
        F.avg(known.cast("double")).alias("match_rate"))


def with_adaptive_match(df: DataFrame, other: DataFrame, exact: dict[str, str],
                        coarse: dict[str, str], values: Sequence[str], order: Sequence[str],
                        probe: str, minimum: float = 0.1) -> DataFrame:
    """Whole-table choice: the exact keys, or the coarse ones if too few rows match.

    Costs one counting job for the decision; ``with_two_tier_match`` needs none.
    """
    matched = with_exact_match(df, other, exact, values, order)
    share = match_rate(matched, probe).first()["match_rate"]
    if share is not None and share < minimum:
        return with_exact_match(df, other, coarse, values, order)
    return matched


def rows_with_known_key(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def settle(bets: DataFrame, results: DataFrame, contest: str = "race_id",
           entry: str = "horse_num") -> DataFrame:
    """Bets with status WIN / LOSE, or SKIP while the result is not known."""
    known = F.col("win_horse_num").isNotNull()
    won = F.col(entry) == F.col("win_horse_num")
    return bets.join(results, contest, "left").withColumns({
        "status": F.when(~known, "SKIP").when(won, "WIN").otherwise("LOSE"),
        "returned": F.when(known & won, F.col("win_payout")).otherwise(0),
    })
