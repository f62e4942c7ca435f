"""Model training and evaluation with Spark ML."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators import encoders, evaluate
from formline.plans import features as feat
from formline.session import park
from formline.skew import pieces

FOLDS = 5
RAW = "_raw"
BLOCK = ["low", "high", "total", "weight"]


def row_fold(*key: str, folds: int = FOLDS) -> Column:
    """Fold of a row by the hash of its key; the same in every run."""
    return F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], share: float = 0.8,
                     piece_rows: int = 250_000) -> DataFrame:
    """``is_train`` for ``share`` of the rows of every label, rounded, in the order of a hash.

    The hash is of the key and all other columns that can be hashed, so rows that share a key, or
    have none, are told apart; equal rows are as good as each other.  Each label's rows are
    numbered within ranges of the hash, of about ``piece_rows`` rows, and the ranges by their
    counts.  Every row is marked where it is: repeated and NULL keys are never joined.
    NULL labels count as empty ones.
    """
    hashed = [c for c, kind in ((f.name, f.dataType) for f in df.schema)
              if c not in key and not isinstance(kind, T.MapType)]
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    ranges = max(1, math.ceil(df.count() / piece_rows))
    place = F.xxhash64(text, *key, *hashed)
    piece = F.least(F.floor((place / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1))
    rows = df.select("*", text.alias("_label"), place.alias("_place"),
                     piece.cast("long").alias("_piece"))
    label_rows = Window.partitionBy("_label")
    earlier = label_rows.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # A row per label and range.
    starts = rows.groupBy("_label", "_piece").agg(F.count("*").alias("_m")).select(
        "_label", "_piece", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_m").over(label_rows).alias("_n"))
    inside = Window.partitionBy("_label", "_piece").orderBy("_place")
    numbered = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["_label", "_piece"]).select(*df.columns, (
        F.col("_start") + F.col("_rn") < F.round(F.col("_n") * share)).alias("is_train"))


def time_folds(df: DataFrame, date: str = "date_dt", folds: int = FOLDS) -> DataFrame:
    """``fold`` 0..folds: consecutive date ranges of about equal size, in date order.

    Fold k is judged by a model of the folds before it (k >= 1).  Rows are counted per
    calendar date, so only dates are ordered.
    """
    day = F.col(date).cast("date")
    days = df.groupBy(day.alias("_d")).agg(F.count("*").alias("m"))
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    cut = days.select("_d", F.least(
        F.floor(F.coalesce(F.sum("m").over(upto), F.lit(0)) * (folds + 1)
                / F.sum("m").over(everything)), F.lit(folds)).cast("int").alias("fold"))
    return df.withColumn("_d", day).join(cut, "_d", "left").drop("_d")


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features",
                           handleInvalid="keep").transform(feat.aligned(df, columns))


def classifier(label: str = "target", **options) -> GBTClassifier:
    given = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42} | options
    return GBTClassifier(labelCol=label, featuresCol="features", **given)


def raw_score(model: GBTClassificationModel, rows: DataFrame, name: str = RAW) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def pool_violators(low, high, total, weight) -> list[tuple]:
    """Blocks (low, high, total, weight) of rising means from blocks in the order of the score."""
    out: list[tuple] = []
    for block in zip(low, high, total, weight, strict=True):
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            before = out.pop()
            block = (before[0], block[1], before[2] + block[2], before[3] + block[3])
        out.append(block)
    return out


def isotonic_blocks(points: DataFrame, score: str, count: int, fan_in: int = 16) -> DataFrame:
    """``low``, ``high``, ``total``, ``weight`` of the blocks of equal fit, of points with one row
    per score and their ``total`` and ``weight``.

    Violators are pooled within ``count`` score ranges, then within ``fan_in`` neighbouring
    ranges at a time, until one is left.  Pooling blocks of a part first does not change the fit.
    With labels of 0 and 1, n rows leave no more than some n ** (2/3) blocks, since the blocks
    have different fractions as their means: that bounds what a later round brings together.
    """
    def pooled(rows):
        rows = rows.sort_values("low")
        blocks = pool_violators(*(rows[c].to_list() for c in BLOCK))
        found = pd.DataFrame(blocks, columns=BLOCK)
        found["_piece"] = rows["_piece"].iloc[0]
        return found

    s = F.col(score).cast("double")
    rows = pieces(points.select(s.alias("low"), s.alias("high"), "total", "weight"), ["low"], count)
    schema = "low double, high double, total double, weight double, _piece long"
    left = count + 1  # the cuts may make one range more
    rows = rows.groupBy("_piece").applyInPandas(pooled, schema)
    while left > 1:
        left = math.ceil(left / fan_in)
        rows = rows.withColumn("_piece", F.floor(F.col("_piece") / fan_in)).groupBy(
            "_piece").applyInPandas(pooled, schema)
    return rows.select(*BLOCK)


def fit_calibration(scored: DataFrame, label: str, score: str = RAW,
                    piece_points: int = 250_000) -> IsotonicRegressionModel:
    """Isotonic fit on rows reduced to one weighted point per distinct score.

    More than ``piece_points`` points are pooled range by range in Spark jobs first; only the
    ends of the blocks that are left reach the fit on the driver.  Rows without score or label
    are left out.
    """
    y = F.col(label).cast("double")
    points = park(scored.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(score).agg(
        F.sum(y).alias("total"), F.count("*").cast("double").alias("weight")), "points")
    count = math.ceil(points.count() / piece_points)
    if count > 1:
        blocks = park(isotonic_blocks(points, score, count), "blocks")
        ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(
            F.array("low"))
        points = blocks.select(F.explode(ends).alias(score), "total", "weight")
    return IsotonicRegression(featuresCol=score, labelCol="y", weightCol="weight").fit(
        points.select(score, (F.col("total") / F.col("weight")).alias("y"), "weight"))


@dataclass
class CalibratedModel:
    """Mean of the calibrated scores of one model per fold."""

    columns: list[str]
    members: list[tuple[GBTClassificationModel, IsotonicRegressionModel]]

    def transform(self, df: DataFrame, name: str = "pred_prob") -> DataFrame:
        rows = assembled(df, self.columns)
        parts = []
        for i, (model, isotonic) in enumerate(self.members):
            rows = raw_score(model, rows, f"_s{i}")
            rows = isotonic.copy({isotonic.featuresCol: f"_s{i}",
                                  isotonic.predictionCol: f"_c{i}"}).transform(rows)
            parts.append(F.col(f"_c{i}"))
        mean = reduce(lambda a, b: a + b, parts) / len(parts)
        scores = [f"_{k}{i}" for i in range(len(parts)) for k in "sc"]
        kept = [c for c in df.columns if c not in self.columns]
        return rows.withColumn(name, mean).drop("features", *scores).select(
            *kept, *[c for c in self.columns if c in df.columns], name)

    def importance(self) -> list[tuple[str, float]]:
        sums = [0.0] * len(self.columns)
        for model, _ in self.members:
            for i, v in zip(model.featureImportances.indices,
                            model.featureImportances.values, strict=True):
                sums[int(i)] += float(v)
        return [(c, v / len(self.members)) for c, v in zip(self.columns, sums, strict=True)]

    def save(self, folder: str) -> None:
        for i, (model, isotonic) in enumerate(self.members):
            model.write().save(f"{folder}/model-{i}")
            isotonic.write().save(f"{folder}/isotonic-{i}")

    @classmethod
    def load(cls, folder: str, columns: Sequence[str], folds: int = FOLDS):
        return cls(list(columns), [
            (GBTClassificationModel.load(f"{folder}/model-{i}"),
             IsotonicRegressionModel.load(f"{folder}/isotonic-{i}")) for i in range(folds)])


def fit_calibrated(train: DataFrame, columns: Sequence[str], label: str = "target",
                   key: Sequence[str] = ("race_id", "horse_num"), folds: int = FOLDS,
                   **options) -> CalibratedModel:
    """Per fold: boosted trees on the other folds, isotonic on the fold's own scores."""
    rows = park(assembled(train, columns).select(label, "features",
                                                 row_fold(*key, folds=folds).alias("_fold")),
                "training")
    members = []
    for k in range(folds):
        model = classifier(label, **options).fit(rows.where(F.col("_fold") != k))
        held_out = raw_score(model, rows.where(F.col("_fold") == k))
        members.append((model, fit_calibration(held_out, label)))
    return CalibratedModel(list(columns), members)


def importance_table(model: CalibratedModel, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        model.importance(), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


ROW_KEY = ("race_id", "horse_num")
FOLD = "_fold"


def encoder_sums(df: DataFrame, keys: Sequence[str], label: str = "target",
                 row_key: Sequence[str] = ROW_KEY, by: Sequence[str] = ()) -> DataFrame:
    """Sums per key, fold and ``by``: all encoders of all folds and periods follow from them."""
    return encoders.key_sums(df.withColumn(FOLD, row_fold(*row_key)), keys, label, [FOLD, *by])


def fitted_encoders(train: DataFrame, label: str = "target", row_key: Sequence[str] = ROW_KEY,
                    keys: Sequence[str] = encoders.TARGET_KEYS,
                    labels: Sequence[str] = encoders.LABEL_COLUMNS, out_of_fold: bool = True,
                    sums: DataFrame | None = None
                    ) -> tuple[DataFrame, encoders.TargetEncoder | None, encoders.LabelEncoder]:
    """(encoded training rows, target encoder or None without keys, label encoder).

    The training rows are encoded out of fold, new rows by the encoders.
    """
    keys = [k for k in keys if k in train.columns]
    classes = encoders.fit_label_encoder(train, labels)
    if not keys:
        return classes.transform(train), None, classes
    sums = encoder_sums(train, keys, label, row_key) if sums is None else sums
    target = encoders.encoder_from_sums(sums, keys)
    if out_of_fold:
        inner = train.withColumn(FOLD, row_fold(*row_key))
        seen = encoders.with_out_of_fold_encoding(inner, keys, label, FOLD, sums=sums).drop(FOLD)
    else:
        seen = target.transform(train)
    return classes.transform(seen), target, classes


def encoded_pair(train: DataFrame, test: DataFrame, label: str = "target", **options
                 ) -> tuple[DataFrame, DataFrame]:
    """Encoders of the training rows, applied to both; training rows are encoded out of fold."""
    train_x, target, classes = fitted_encoders(train, label, **options)
    return train_x, classes.transform(target.transform(test) if target else test)


def walk_forward(features: DataFrame, first_test: int, *, period: str = "year",
                 label: str = "target", without: Sequence[str] = (),
                 build: Callable[[DataFrame], DataFrame] | None = None,
                 keys: Sequence[str] = encoders.TARGET_KEYS,
                 labels: Sequence[str] = encoders.LABEL_COLUMNS, **options) -> DataFrame:
    """Score every period from ``first_test`` on with a model of all earlier periods.

    The rows are read once for the encoders of all periods.  With ``build``, the table holds
    raw rows and the features of each side are built from its own rows alone, so a test
    period starts without history.
    """
    periods = sorted(r[0] for r in features.select(period).distinct().collect()
                     if r[0] is not None)  # one value per year
    tested = [p for p in periods if p >= first_test and p > periods[0]]
    if not tested:
        raise ValueError(f"no period to test from {first_test} on")
    known = [k for k in keys if k in features.columns]
    sums = encoder_sums(features, known, label, by=[period]) if known and not build else None
    scored = []
    for test_period in tested:
        earlier = F.col(period) < test_period
        train, test = features.where(earlier), features.where(F.col(period) == test_period)
        if build:
            train, test = park(build(train), "train"), park(build(test), "test")
        train_x, test_x = encoded_pair(
            train, test, label, keys=keys, labels=labels,
            sums=None if sums is None else sums.where(earlier))
        columns = feat.model_columns(train_x, [period, *without])
        model = fit_calibrated(train_x, columns, label, **options)
        scored.append(park(model.transform(test_x), f"scored-{test_period}"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scored)


def _settings(grid: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def _loss(train: DataFrame, judged: DataFrame, label: str, options: dict) -> float:
    scored = raw_score(classifier(label, **options).fit(train), judged)
    return scored.agg(evaluate.log_loss(F.col(label), F.col(RAW))).first()[0]


def sweep(train: DataFrame, columns: Sequence[str], grid: dict[str, Sequence],
          label: str = "target", date: str = "date_dt", folds: int = FOLDS
          ) -> list[tuple[dict, float]]:
    """Mean log loss of each setting over the ordered folds, best first."""
    rows = park(assembled(time_folds(train, date, folds), columns).select(
        label, "features", "fold"), "sweep")
    fold = F.col("fold")
    results = [(options, sum(_loss(rows.where(fold < k), rows.where(fold == k), label, options)
                             for k in range(1, folds + 1)) / folds)
               for options in _settings(grid)]
    return sorted(results, key=lambda r: r[1])


def holdout_sweep(train: DataFrame, columns: Sequence[str], grid: dict[str, Sequence],
                  held_out: int, label: str = "target", period: str = "year"
                  ) -> list[tuple[dict, float]]:
    """Log loss of each setting on one period, trained on the earlier ones, best first."""
    rows = park(assembled(train, columns).select(label, "features", period), "sweep")
    before, judged = rows.where(F.col(period) < held_out), rows.where(F.col(period) == held_out)
    results = [(o, _loss(before, judged, label, o)) for o in _settings(grid)]
    return sorted(results, key=lambda r: r[1])


def train_and_refit(features: DataFrame, test_from: int, *, period: str = "year",
                    label: str = "target", fit: Callable = fit_calibrated, **options):
    """(scored test rows, model refitted on all rows with the same columns, its encoders)."""
    train = features.where(F.col(period) < test_from)
    test = features.where(F.col(period) >= test_from)
    train_x, test_x = encoded_pair(train, test, label)
    columns = feat.model_columns(train_x, [period])
    scored = fit(train_x, columns, label, **options).transform(test_x)
    everything, target, classes = fitted_encoders(features, label)
    return scored, fit(everything, columns, label, **options), target, classes
