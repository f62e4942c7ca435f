"""History windows: the small fixture, no look-ahead, and hot keys against brute force."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.tables import results
from formline import skew
from formline.operators import agents, contest, history
from formline.plans import features as feat
from formline.skew import OrderedRows, global_running, nulls_last, pieces, with_group_stats

FIXTURE = [
    ("202301010101", "2023年1月5日", "H1", 1, 100.0, "1/2", "J1", "T1", 1600, "芝", "晴", "良",
     480, 3, 2.5, "1-1"),
    ("202301010101", "2023年1月5日", "H2", 2, 50.0, "ハナ", "J2", "T2", 1600, "芝", "晴", "良",
     500, 3, 3.0, "2-2"),
    ("202301020101", "2023年2月5日", "H1", 2, 50.0, "大差", "J1", "T1", 2000, "ダ", "雨", "重",
     482, 3, 4.0, "1-1"),
    ("202301020101", "2023年2月5日", "H2", 1, 100.0, "1 1/4", "J2", "T2", 2000, "ダ", "雨", "重",
     498, 3, 1.5, "2-2"),
]
NAMES = ("race_id date horse_id rank prize margin jockey_id trainer_id distance surface weather"
         " condition horse_weight age odds passing_order").split()


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.createDataFrame(FIXTURE, NAMES).withColumn(
        "horse_num", F.substring("horse_id", 2, 1).cast("int"))
    from formline.functions import scalars as S
    df = df.withColumn("date_dt", S.strict_japanese_date("date"))
    rows = feat.build_features(df).orderBy("race_id", "horse_num").collect()
    return [r.asDict() for r in rows]


@pytest.mark.parametrize("name, expected", [
    ("interval", [0, 0, 31, 31]), ("prev_rank", [99, 99, 1, 2]), ("rank_5_std", [0] * 4),
    ("distance_category", ["Mile", "Mile", "Intermediate", "Intermediate"]),
    ("weight_bin", ["Heavy"] * 4), ("running_style", ["Nigeru", "Senko"] * 2),
    ("avg_rank_turf", [99, 99, 1, 2]), ("avg_rank_dirt", [99] * 4),
    ("same_jockey", [0, 0, 1, 1]), ("jockey_win_rate_100", [0] * 4),
    ("margin_val", [0.5, 0.05, 10.0, 1.25]), ("rate_Nigeru_5", [0, 0, 1, 0]),
    ("race_pace_index", [0, 0, 2.5, 2.5]), ("target", [1, 0, 0, 1]),
    ("prev_prize", [0, 0, 100, 50]), ("prev_odds", [None, None, 2.5, 3.0]),
    ("sire_surface", ["unknown_芝", "unknown_芝", "unknown_ダ", "unknown_ダ"]),
])
def test_fixture(wide, name, expected):
    assert [r[name] for r in wide] == expected


def test_month_cycle(wide):
    assert wide[0]["month_sin"] == pytest.approx(0.5)


def test_lone_entrant_has_zero_zscore(spark):
    df = spark.createDataFrame([("a", 1, 5.0)], "race_id string, horse_num int, age double")
    row = feat.filled(contest.with_relative(df, ["age"])).first()
    assert row["age_race_std"] is None and row["age_zscore"] == 0


def rows(n, seed, hot=0.4):
    """Rows of many entrants; one holds a good share, some share a time, some lack keys."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        who = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, "d"])
        when = start + dt.timedelta(minutes=rng.randrange(n // 3)) if rng.random() > .02 else None
        rank = rng.choice([None, *range(1, 13)])
        out.append((f"r{rng.randrange(9)}", i, who, when, rank, rng.random() * 50))
    return out


DDL = "race_id string, horse_num int, horse_id string, date_dt timestamp_ntz, rank int, odds double"


def computed(spark, data, **skew):
    df = spark.createDataFrame(data, DDL).repartition(5)
    o = history.entrant_rows(df, halo=100, **skew)
    new = history.lags(o, (("rank", 1, "l1", 99), ("rank", 3, "l3", 99)))
    new |= history.rolling(o, {"rank": ("mean", "std", "median"), "odds": ("max", "sum")},
                           (3, 100))
    new["gap"] = history.day_gap(o)
    base = o.rows.select("*", *[c.alias(n) for n, c in new.items()])
    base = history.with_suitability(o, {"low": F.col("odds") < 25}, df=base)
    out = o.finish(base)
    names = sorted(c for c in out.columns)
    return {r["horse_num"]: [r[c] for c in names] for r in out.collect()}, names


def test_hot_entrant_same_as_plain(spark):
    data = rows(2500, 7)
    plain, names = computed(spark, data)
    sliced, same = computed(spark, data, hot_rows=300, slice_rows=130)
    assert names == same and plain.keys() == sliced.keys() and len(plain) == 2500
    for k, row in plain.items():
        for name, a, b in zip(names, row, sliced[k], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9), (k, name)


def test_windows_stay_inside_the_slices(spark):
    df = spark.createDataFrame(rows(3000, 3, hot=0.9), DDL)
    o = OrderedRows(df, ["horse_id"], ["date_dt", "horse_num"], halo=10, hot_rows=100,
                    slice_rows=200)
    sizes = o.rows.groupBy("horse_id", "_slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 210


def test_one_time_for_all_rows(spark):
    """Ties of the first ordering column are cut by the next ones."""
    rng = random.Random(8)
    day = dt.datetime(2024, 5, 5)
    data = [(f"2024{rng.randrange(40):08d}", i, "hot" if rng.random() < .9 else None,
             day if rng.random() < .95 else None, rng.randrange(1, 13), rng.random())
            for i in range(1500)]
    plain, names = computed(spark, data)
    sliced, _ = computed(spark, data, hot_rows=100, slice_rows=120)
    for k, row in plain.items():
        for name, a, b in zip(names, row, sliced[k], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9), (k, name)
    df = spark.createDataFrame(data, DDL).where("horse_id = 'hot'")
    cut = pieces(df, ["date_dt", "race_id", "horse_num"], 20)
    assert cut.groupBy("_piece").count().agg(F.max("count")).first()[0] < 300


@pytest.mark.parametrize("order", [["t"], ["d", "i"], ["x", "i"], ["n", "x", "i"], ["f", "t"],
                                   ["i"]])
def test_pieces_keep_the_order(spark, order):
    rng = random.Random(3)
    def some(v):
        return v if rng.random() > .1 else None
    data = [(i + 2**40, some(rng.choice("ab") + "é" * rng.randrange(9) + str(rng.randrange(99))),
             some(dt.date(2024, 1, 1 + rng.randrange(3))),
             some(rng.choice([0.0, -0.0, 5.0, float("nan"), float("inf"), rng.random()])),
             some(dt.datetime(2024, 1, 1, 0, 0, 0, rng.randrange(50))), some(rng.random() < .5))
            for i in range(900)]
    df = spark.createDataFrame(
        data, "i bigint, t string, d date, x double, n timestamp_ntz, f boolean")
    got = pieces(df, order, 15).orderBy(*nulls_last(order)).select("_piece").collect()
    seen = [r[0] for r in got]
    assert seen == sorted(seen) and len(set(seen)) > 1


def test_hot_agent_and_contest_same_as_plain(spark):
    df = spark.createDataFrame(rows(1500, 5), DDL)
    order = ["date_dt", "race_id", "horse_num"]

    def both(**skew):
        a = agents.with_agent_rates(df, "horse_id", "x", order=order, **skew)
        b = contest.with_display_order(a, "odds", **skew)
        c = with_group_stats(b, ["horse_id"], {"mean": F.avg("rank"), "n": F.count("*")},
                             hot_rows=skew.get("hot_rows"))
        return {r["horse_num"]: r for r in c.collect()}

    plain, sliced = both(), both(hot_rows=100, slice_rows=150)
    for k, row in plain.items():
        for a, b in zip(row, sliced[k], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-9)


def test_no_look_ahead(spark):
    data = rows(400, 11)
    last = max(r[3] for r in data if r[3])
    changed = [(*r[:4], 12, 999.0) if r[3] == last else r for r in data]
    before, names = computed(spark, data)
    after, _ = computed(spark, changed)
    own = [names.index(n) for n in ("rank", "odds")]
    for r in data:
        if r[3] and r[3] <= last:
            a, b = before[r[1]], after[r[1]]
            same = [x for i, x in enumerate(a) if i not in own]
            if r[3] < last:
                assert same == [x for i, x in enumerate(b) if i not in own]


def test_decayed_mean_keeps_the_age_of_missing_values(spark):
    data = [("r", i, "h", dt.datetime(2024, 1, 1 + i), x, 1.0)
            for i, x in enumerate([None, 1, None, 3, 4, 4])]
    df = spark.createDataFrame(data, DDL)
    o = history.entrant_rows(df, halo=history.decay_rows(5))
    got = [r["m"] for r in o.finish(history.with_decayed_means(o, {"m": "rank"}))
           .orderBy("horse_num").collect()]
    # Entry i holds the mean of the rows before i.
    assert got[:2] == [None, None] and got[2:4] == [1.0, 1.0]
    assert got[4:6] == pytest.approx([2.384615, 3.207547], abs=1e-6)


def test_decayed_mean_survives_a_long_gap(spark):
    data = [("r", i, "h", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 4 if i < 2 else None,
             1.0) for i in range(400)]
    df = spark.createDataFrame(data, DDL)
    for skew in ({}, {"hot_rows": 50, "slice_rows": 100}):
        o = history.entrant_rows(df, halo=history.decay_rows(5), **skew)
        out = o.finish(history.with_decayed_means(o, {"m": "rank"}))
        assert out.where("horse_num > 0").select("m").distinct().collect()[0][0] == 4.0
        assert out.count() == 400


def test_decayed_mean_over_slices(spark):
    """A hot entrant of several slices has the means of the plain path."""
    rng = random.Random(5)
    data = [("r", i, "h" if i % 50 else "cold", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
             rng.choice([None, 1, 2, 9]), 1.0) for i in range(6000)]
    df = spark.createDataFrame(data, DDL)

    def means(**skew):
        o = history.entrant_rows(df, halo=history.decay_rows(5), **skew)
        found = o.finish(history.with_decayed_means(o, {"m": "rank"}))
        return {r["horse_num"]: r["m"] for r in found.collect()}
    plain, sliced = means(), means(hot_rows=500, slice_rows=history.decay_rows(5))
    assert plain.keys() == sliced.keys() and len(plain) == 6000
    assert all(plain[k] == sliced[k] or plain[k] == pytest.approx(sliced[k], rel=1e-12)
               for k in plain)


def test_global_running(spark):
    rng = random.Random(2)
    xs = [rng.choice([1.0, 2.0, rng.random() * 9]) for _ in range(900)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["s"] for r in global_running(
        df, ["x", "i"], {"s": F.lit(1)}, piece_rows=50).collect()}
    order = sorted(range(900), key=lambda i: (xs[i], i))
    assert [got[i] for i in order] == list(range(900))


def test_hot_keys_of_all_columns_come_from_one_pass(spark, monkeypatch):
    df = results(spark, "/root/testdata/sf0.001").drop("event_id", "day", "period", "pred_prob",
                                                       "pred_b")
    df = df.withColumn("horse_id", F.when(F.col("horse_num") % 3 == 0, "hot").when(
        F.col("horse_num") % 7 != 0, F.col("horse_id")))
    found = feat.hot_by_key(df, ["jockey_id", "horse_id", "race_id", "missing"], 60)
    assert set(found) == {"jockey_id", "horse_id", "race_id"}
    for key, table in found.items():
        plain = skew.hot_keys(df, [key], 60)
        rows = [] if plain is None else sorted(map(tuple, plain.collect()))
        assert (table is None) == (plain is None)
        assert rows == ([] if table is None else sorted(map(tuple, table.collect())))
    assert found["horse_id"] is not None and found["race_id"] is None
    assert feat.hot_by_key(df.limit(0), ["race_id"], 1) == {"race_id": None}

    columns = ["jockey_win_rate_100", "trainer_show_rate_100", "rank_5_mean", "rank_100_median",
               "avg_rank_turf", "age_zscore", "race_pace_index", "prev_rank"]

    def rows_of(wide):
        return {r.horse_num: tuple(r[c] and round(float(r[c]), 9) for c in columns)
                for r in wide.select("horse_num", *columns).collect()}

    plain = rows_of(feat.build_features(df))

    def counted(*_):
        raise AssertionError("a key was counted on its own")

    monkeypatch.setattr(skew, "hot_keys", counted)
    assert rows_of(feat.build_features(df, hot_rows=5, slice_rows=110)) == plain
    assert rows_of(feat.build_features(df, hot_rows=60, slice_rows=110)) == plain


def test_rolling_pass_equals_the_windows(spark):
    """One pass over ordered rows: blocks, hot slices, NULL keys, NaN, whole and long numbers."""
    from formline.operators import history
    rows = [(None if i % 41 == 0 else f"h{i * i % 7}", i, f"r{i % 3}", i,
             None if i % 5 == 0 else i * 7 % 12, float("nan") if i % 29 == 0 else i % 9 / 7,
             2**53 + i % 4, None if i < 600 else 1.1) for i in range(1300)]
    df = spark.createDataFrame(rows, "horse_id string, date_dt long, race_id string, horse_num int,"
                                     " a int, b double, c long, d double")
    all_of = ("mean", "std", "min", "max", "sum", "median")
    targets, windows = {c: all_of for c in "abcd"}, (3, 100)
    for skew in ({}, {"hot_rows": 150, "slice_rows": 120}):
        o = history.entrant_rows(df, **skew)
        plain = history.rolling(o, targets, windows)
        one = o.finish(o.rows.select("*", *[x.alias(n) for n, x in plain.items()]))
        two = o.finish(history.with_rolling(o, targets, windows))
        assert one.select(*two.columns).dtypes == two.dtypes

        def values(t):
            return sorted((tuple("nan" if x != x else round(x, 9) if isinstance(x, float) else x
                                 for x in r) for r in t.select("horse_num", *plain).collect()))
        assert values(one) == values(two)


def test_rolling_pass_needs_no_exact_percentile(spark):
    from formline.operators import history
    df = spark.createDataFrame([("h", 1, "r", 1, 2)], "horse_id string, date_dt long,"
                                                      " race_id string, horse_num int, rank int")
    plan = history.with_rolling(history.entrant_rows(df))._jdf.queryExecution().executedPlan()
    assert "percentile" not in plan.toString() and "MapInArrow" in plan.toString()


def sliced_values(spark, **skew):
    df = spark.createDataFrame(rows(2500, 7), DDL).repartition(5)
    o = history.entrant_rows(df, halo=100, **skew)
    base = o.rows.select("*", o.over(F.sum("rank"), o.last(100)).alias("s"))
    base = history.with_suitability(o, {"low": F.col("odds") < 25}, df=base)
    return o, {r.horse_num: (r.s, round(r.avg_rank_low, 9)) for r in o.finish(base).collect()}


def test_keys_of_one_window_need_no_ranges(spark, monkeypatch):
    """only keys too large for one window are numbered range by range."""
    plain = sliced_values(spark)[1]
    ranged = sliced_values(spark, hot_rows=20, slice_rows=130, whole_rows=20)[1]

    def cut(*_):
        raise AssertionError("the order was cut into ranges")

    monkeypatch.setattr(skew, "pieces", cut)
    o, whole = sliced_values(spark, hot_rows=20, slice_rows=130)
    assert o.rows.agg(F.countDistinct("_slice")).first()[0] > 5
    assert whole == plain == ranged


def test_no_slice_is_halo_alone(spark):
    """a key that ends in its slice is not copied into the next one."""
    df = spark.createDataFrame(rows(900, 3), DDL)
    o = OrderedRows(df, ["horse_id"], ["date_dt", "horse_num"], halo=200, hot_rows=20,
                    slice_rows=200)
    own = o.rows.groupBy("horse_id", "_slice").agg(F.min(F.col("_halo").cast("int")).alias("h"))
    assert own.agg(F.max("h")).first()[0] == 0


def test_rows_of_a_task_do_not_grow(spark, monkeypatch):
    """F16, F18: more rows make more tasks, also with few shuffle partitions."""
    monkeypatch.setattr(skew, "TASK_VALUES", 2000)
    df = spark.range(20_000).select((F.col("id") % 500).alias("k"), "id").withColumn(
        "k", F.when(F.col("k") > 9, F.col("k")))
    o = OrderedRows(df, ["k"], ["id"], halo=1)
    stats = with_group_stats(df, ["k"], {"n": F.count("*")})
    for out in (o.rows.select("*", o.over(F.lag("id"), o.spec).alias("l")), stats):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2500
    assert stats.where("k IS NOT NULL").agg(F.min("n"), F.max("n")).first()[:] == (40, 40)


def test_frames_are_laid_out_for_the_asked_rows_alone(spark, monkeypatch):
    """Rows that are not asked for are read as history: same values, fewer rows."""
    df = spark.range(3000).selectExpr(
        "concat('h', id % 3) AS horse_id", "id AS date_dt", "'r' AS race_id", "id AS horse_num",
        "CAST(hash(id) % 50 AS double) AS odds", "id > 2000 AND id % 7 = 0 AS asked")
    targets = {"odds": ("mean", "median", "std")}

    def rows(only):
        o = history.entrant_rows(df)
        out = o.finish(history.with_rolling(o, targets, df=o.rows, only=only))
        return sorted(out.where("asked").collect()), out.count()
    whole, n = rows(None)
    some, m = rows("asked")
    assert n == 3000 and m == len(some) == len(whole) > 100 and some == whole
    none = df.withColumn("asked", F.lit(False))
    o = history.entrant_rows(none)
    assert history.with_rolling(o, targets, df=o.rows, only="asked").count() == 0
