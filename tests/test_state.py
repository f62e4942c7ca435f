"""Day state against features over the whole past, row for row."""

import pytest
from pyspark.sql import functions as F

from checks.tables import results
from formline.plans import daily, state
from formline.plans import features as feat

SMALL = "/root/testdata/sf0.001"
DAY = "2024-01-20"
AFTER = ("rank", "prize", "agari_3f", "passing_order", "time", "margin")


def rows_of(df, columns):
    return {(r.race_id, r.horse_num): tuple(
        round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)
        for r in df.select("race_id", "horse_num", *[c for c in columns if c not in (
            "race_id", "horse_num")]).collect()}


@pytest.fixture(scope="module")
def table(spark):
    df = results(spark, SMALL).drop("event_id", "day", "period", "pred_prob", "pred_b")
    # Some unknown entrants and agents, and many rows of one entrant.
    key = F.xxhash64("race_id", "horse_num")
    return df.withColumns({
        "horse_id": F.when(key % 11 == 0, None).when(key % 3 == 0, "hot").otherwise(
            F.col("horse_id")),
        "jockey_id": F.when(key % 13 == 0, None).otherwise(F.col("jockey_id"))}).cache()


def split(table, day):
    date = F.col("date_dt").cast("date")
    return table.where(date < day), table.where(date == day).drop(*AFTER)


def test_features_from_state_equal_those_of_the_whole_past(spark, table, tmp_path):
    past, today = split(table, DAY)
    assert today.count() > 5 and past.groupBy("horse_id").count().agg(
        F.max("count")).first()[0] > 150
    means = feat.rate_means(feat.build_features(past))
    whole = daily.score_day(past, today, DAY, lambda w: w, means=means, only_relevant=False)
    state.DayState.of(past).save(spark, str(tmp_path / "state"))
    kept = state.DayState.load(spark, str(tmp_path / "state"))
    assert kept.entrants.groupBy("horse_id").count().agg(F.max("count")).first()[0] == 100
    found = daily.score_day(kept, today, DAY, lambda w: w, means=means)
    columns = feat.model_columns(whole)
    assert len(columns) > 250 and not set(columns) - set(found.columns)
    assert rows_of(found, columns) == rows_of(whole, columns)


def test_state_advances_day_by_day(spark, table):
    date = F.col("date_dt").cast("date")
    step = state.DayState.of(table.where(date < "2024-01-10"))
    for first, before in (("2024-01-10", "2024-01-11"), ("2024-01-11", DAY)):
        step = step.advanced(table.where((date >= first) & (date < before)))
    once = state.DayState.of(table.where(date < DAY))
    for a, b in ((step.entrants, once.entrants), (step.totals, once.totals),
                 *((step.agents[p], once.agents[p]) for p in once.agents)):
        assert a.count() == b.count() and a.select(b.columns).exceptAll(b).count() == 0
    assert step.until == once.until
    with pytest.raises(ValueError, match="until"):
        step.advanced(table.where(date == "2024-01-15"))
    with pytest.raises(ValueError, match="until"):
        step.features(split(table, "2024-01-15")[1], means={})


def test_empty_past_and_empty_day(spark, table):
    none = state.DayState.of(table.limit(0))
    _, today = split(table, DAY)
    first = daily.score_day(none, today, DAY, lambda w: w, means={})
    assert {r.prev_rank for r in first.select("prev_rank").collect()} == {99.0}
    assert first.count() == daily.prepared_entries(today, DAY).count() > 0
    assert daily.score_day(none, today.limit(0), DAY, lambda w: w, means={}).count() == 0


def test_only_todays_contests_leave_the_history(spark):
    """Whole-past scoring keeps today's contests alone, with the features of the whole table."""
    from checks.tables import results
    from formline.plans import features as feat
    df = results(spark, "/root/testdata/sf0.001").drop("event_id", "day", "period")
    means = feat.means_of(df)
    wide = feat.build_features(df, means=means)
    assert {k: round(v, 9) for k, v in means.items()} == {
        k: round(v, 9) for k, v in feat.rate_means(wide).items()}
    ids = df.select("race_id").distinct().orderBy("race_id").limit(3)
    some = feat.build_features(df, means=means, contests=ids)
    expected = wide.join(ids, "race_id", "left_semi").select(*some.columns)
    assert 0 < some.count() < wide.count() and not some.exceptAll(expected).count()
    assert some.count() == expected.count()


def test_wide_rows_are_written_once_and_never_shuffled(spark, monkeypatch):
    """Shuffles of the feature table hold narrow rows, whatever the number of rows."""
    from formline import skew
    df = results(spark, SMALL).drop("event_id", "day", "period")
    parked, plans = [], []

    def park(rows, label, *args, **options):
        parked.append((label, len(rows.columns)))
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return keep(rows, label, *args, **options)
    keep = feat.park
    expected = feat.build_features(df)
    monkeypatch.setattr(feat, "park", park)
    monkeypatch.setattr(skew, "TASK_VALUES", 5_000)  # rows are dealt to many tasks
    found = feat.build_features(df)
    assert [n for n, columns in parked if columns > 100] == ["features"]
    joins = [line for line in plans[-1].splitlines() if "Join" in line]
    assert len(joins) == 1 and "LeftOuter" in joins[0]  # contests, broadcast
    columns = feat.model_columns(expected)
    assert found.columns == expected.columns and len(columns) > 250
    assert rows_of(found, columns) == rows_of(expected, columns)


def test_contest_columns_are_the_same_from_a_large_table(spark, monkeypatch):
    """The statistics of many contests are joined before the windows; NULL contests get none."""
    df = results(spark, SMALL).drop("event_id", "day", "period")
    df = df.withColumn("race_id", F.when(F.col("horse_num") % 9 != 0, F.col("race_id")))
    expected = feat.build_features(df)
    monkeypatch.setattr(feat, "BROADCAST_ROWS", 5)
    found = feat.build_features(df)
    columns = feat.model_columns(expected)
    assert found.columns == expected.columns
    assert rows_of(found, columns) == rows_of(expected, columns)
    assert found.where("race_id IS NULL AND age_race_mean IS NOT NULL").count() == 0
