"""Model training and evaluation; no SQL can say the same, so rows only."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.history import KEY, selected
from checks.registry import query
from checks.tables import R, results
from formline.functions import scalars as S
from formline.operators import agents, encoders, evaluate, history
from formline.plans import features as feat
from formline.plans import bundle, training
from formline.session import park, scratch_folder

SMALL = {"maxIter": 3, "maxDepth": 3}
TRAITS = ("horse_weight", "age", "weight", "distance", "prev_rank", "rank_5_mean",
          "jockey_win_rate_100")


def features(spark, sf):
    """A narrow feature table over all contests, with an outcome that depends on two traits."""
    df = results(spark, sf, *KEY, "event_id", "period", "horse_id", "jockey_id", "trainer_id",
                 "date_dt", "rank", "odds", "horse_weight", "age", "weight", "distance",
                 "weather", "gender")
    o = history.entrant_rows(df, halo=5)
    new = {"prev_rank": history.lags(o)["prev_rank"]}
    new |= history.rolling(o, {"rank": ("mean",)}, (5,))
    wide = selected(o, new, [c for c in df.columns])
    wide = agents.with_agent_rates(wide, "jockey_id", "jockey")
    planted = F.pmod(F.xxhash64("event_id"), F.lit(10)) + F.col("age") * 2 - F.col("weight") / 20
    return park(wide.withColumn("target", (planted > 12).cast("int")), "model-features")


@query("walk_forward")
def walk_forward(spark, sf):
    """Per period a calibrated model of all earlier periods."""
    scored = training.walk_forward(features(spark, sf), 2023, period="period", folds=3,
                                   without=["event_id"], **SMALL)
    return scored.groupBy("period").agg(
        F.count("*").alias("n"), F.avg("pred_prob").alias("mean_prob"),
        evaluate.log_loss(F.col("target"), F.col("pred_prob")).alias("logloss"))


def split(spark, sf):
    wide = features(spark, sf)
    return wide.where("period < 2023"), wide.where("period >= 2023")


@query("calibrated_classifier")
def calibrated_classifier(spark, sf):
    train, test = split(spark, sf)
    model = training.fit_calibrated(train, TRAITS, folds=3, **SMALL)
    return model.transform(test.select(*KEY, "target", *TRAITS)).select(*KEY, "target",
                                                                        "pred_prob")


@query("blended_models")
def blended_models(spark, sf):
    """Two models blended with the weight of least log loss."""
    train, test = split(spark, sf)
    first = training.fit_calibrated(train, TRAITS, folds=3, **SMALL)
    second = training.fit_calibrated(train, TRAITS[:4], folds=3, **SMALL)
    scored = park(second.transform(first.transform(test, "p1"), "p2"), "blend")
    weight = evaluate.best_weight(evaluate.blend_search(scored, "p1", "p2")).first()["weight"]
    mixed = scored.withColumn("pred_prob", evaluate.blend("p1", "p2", weight))
    return evaluate.score_quality(mixed).withColumn("weight", F.lit(weight))


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = split(spark, sf)
    model = training.fit_calibrated(train, TRAITS, folds=3, **SMALL)
    return training.importance_table(model, train)


@query("setting_sweep")
def setting_sweep(spark, sf):
    """Log loss of each setting over consecutive date folds."""
    train, _ = split(spark, sf)
    grid = {"maxDepth": [2, 4], "maxIter": [2], "stepSize": [0.1, 0.3]}
    rows = [(o["maxDepth"], o["stepSize"], loss)
            for o, loss in training.sweep(train, TRAITS, grid, folds=2)]
    return spark.createDataFrame(rows, "max_depth int, step_size double, logloss double")


@query("setting_sweep_held_out_period")
def setting_sweep_held_out_period(spark, sf):
    train, _ = split(spark, sf)
    found = training.holdout_sweep(train, TRAITS, {"maxDepth": [2, 4], "maxIter": [2]}, 2022,
                                   period="period")
    return spark.createDataFrame([(o["maxDepth"], loss) for o, loss in found],
                                 "max_depth int, logloss double")


@query("walk_forward_without_history")
def walk_forward_without_history(spark, sf):
    """The first-generation features, built separately for each side of every split."""
    df = results(spark, sf, *KEY, "period", "horse_id", "jockey_id", "trainer_id", "date_dt",
                 "rank", "prize", "odds", "surface", "weight_change", "time", "horse_weight",
                 "age", "weather", "gender")
    scored = training.walk_forward(df, 2024, period="period", folds=2,
                                   build=feat.build_baseline_features,
                                   keys=encoders.BASELINE_KEYS,
                                   labels=encoders.BASELINE_LABELS, **SMALL)
    return evaluate.yearly_money(scored.withColumnRenamed("period", "year"), 0.5)


@query("train_and_refit")
def train_and_refit(spark, sf):
    scored, final = bundle.train_and_refit(features(spark, sf).drop("event_id"), 2023,
                                           period="period", folds=3, **SMALL)
    figures = evaluate.score_quality(scored)
    return figures.withColumn("columns", F.lit(len(final.model.columns)))


# Scores of the saved and loaded bundle are those of the one in memory, for every row.
@query("saved_scoring", f"""WITH {R} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different,
 CAST(0 AS BIGINT) AS outside FROM r WHERE period >= 2023""")
def saved_scoring(spark, sf):
    wide = features(spark, sf).drop("event_id")
    _, final = bundle.train_and_refit(wide, 2023, period="period", folds=2, **SMALL)
    folder = f"{scratch_folder(spark)}/bundle-{uuid.uuid4().hex}"
    final.save(spark, folder)
    again = bundle.ScoringBundle.load(spark, folder)
    rows = wide.where("period >= 2023")
    one = final.score(rows).select(*KEY, F.col("pred_prob").alias("p"))
    two = again.score(rows).select(*KEY, F.col("pred_prob").alias("q"))
    return one.join(two, list(KEY)).agg(
        F.count("*").alias("n"), F.count_if(F.col("p") != F.col("q")).alias("different"),
        F.count_if(~F.col("p").between(0, 1)).alias("outside"))


@query("stratified_split", f"""WITH {R}, t AS (SELECT CASE WHEN rank = 1 THEN 1 ELSE 0 END AS target
 FROM r) SELECT target, count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS n_train
 FROM t GROUP BY 1""")
def stratified_split(spark, sf):
    """80 % of each label, to the row."""
    df = results(spark, sf, *KEY, "rank").withColumn("target", S.is_winner("rank"))
    marked = training.stratified_split(df, "target", KEY)
    return marked.groupBy("target").agg(F.count("*").alias("n"),
                                        F.count_if("is_train").alias("n_train"))
