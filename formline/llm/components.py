"""Connected components of links, by alternating stars; nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import park


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a > b): neighbours of a node move to its smallest one."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("m", "u"))
    joined = sides.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"),
                                                             F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(
            F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id; the component is its smallest id.

    ``links`` has long columns a and b; direction, repeats, loops and NULLs do not matter.
    """
    now = park(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_stars(now):
        now = park(_starred(_starred(now, large=True), large=False).distinct(), "stars")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _is_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one node, and that one on none."""
    sides = links.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")
                         ).unionByName(links.select("b", F.lit(0), F.lit(1)).toDF(
                             "id", "child", "parent"))
    odd = sides.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where(
        (F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0)))
    return odd.limit(1).count() == 0
