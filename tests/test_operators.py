"""Encoders, tickets, allocation, joins, evaluation and profiles on small cases."""

import itertools
import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from formline import schemas
from formline.operators import encoders, evaluate, joins, policy, profile, tickets
from formline.plans import features as feat
from formline.plans import training


def test_global_encoding_of_unseen_and_missing_keys(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0)],
                                  "k string, target int")
    fitted = encoders.fit_target_encoder(train, ["k", "gone"])
    test = spark.createDataFrame([(0, "a"), (1, "z"), (2, None)], "i int, k string")
    got = [r["k_target_enc"] for r in fitted.transform(test).orderBy("i").collect()]
    assert got == pytest.approx([(1 + 0.5 * 10) / 12, 0.5, 0.5])


def test_column_without_any_key(spark):
    train = spark.createDataFrame([("a", None, 1), ("b", None, 0)],
                                  "k string, e string, target int")
    fitted = encoders.fit_target_encoder(train, ["k", "e"])
    assert {r[0] for r in fitted.transform(train).select("e_target_enc").collect()} == {0.5}


def test_out_of_fold_against_a_fold_loop(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "a", "b", f"rare{i}", None]), i % 5,
             int(rng.random() < .3)) for i in range(300)]
    df = spark.createDataFrame(data, "i int, k string, fold int, target int")
    got = {r["i"]: r["k_target_enc"] for r in
           encoders.with_out_of_fold_encoding(df, ["k"]).collect()}
    for i, k, fold, _ in data:
        others = [d for d in data if d[2] != fold]
        mean = sum(d[3] for d in others) / len(others)
        mine = [d[3] for d in others if d[1] == k and k is not None]
        want = (sum(mine) + 10 * mean) / (len(mine) + 10) if mine else mean
        assert got[i] == pytest.approx(want)


def test_own_label_never_changes_own_encoding(spark):
    data = [(i, "a" if i % 3 else "b", i % 5, i % 2) for i in range(60)]
    flipped = [(i, k, f, 1 - t if i == 7 else t) for i, k, f, t in data]
    ddl = "i int, k string, fold int, target int"
    one, two = (encoders.with_out_of_fold_encoding(spark.createDataFrame(d, ddl), ["k"])
                .where("i = 7").first()["k_target_enc"] for d in (data, flipped))
    assert one == two


@pytest.mark.parametrize("limits", [{"room": 0}, {"room": 0, "heavy_rows": 20}, {"room": 6}])
def test_long_lookup_equals_broadcasts(spark, limits):
    """All columns in long format, heavy keys apart, and a mix; repeated rows stay."""
    rng = random.Random(9)
    data = [(i // 2, rng.choice(["hot", "hot", "b", f"r{i}", None]), rng.choice("xyz"), None,
             rng.choice([0, 1, 2, 3, 4, None]), int(rng.random() < .4)) for i in range(200)]
    df = spark.createDataFrame(
        data, "i int, k string, l string, empty string, fold int, target int")
    keys = ["k", "l", "empty"]
    rows = df.select("i", "fold", *keys)

    def exact(got):
        return sorted(map(str, got.collect()))

    encoder, labels = encoders.fit_target_encoder(df, keys), encoders.fit_label_encoder(df, keys)
    assert exact(encoder.transform(rows, **limits)) == exact(encoder.transform(rows))
    assert exact(labels.transform(rows, **limits)) == exact(labels.transform(rows))
    assert labels.transform(rows, **limits).columns == rows.columns
    assert exact(encoders.with_out_of_fold_encoding(df, keys, **limits)) == \
        exact(encoders.with_out_of_fold_encoding(df, keys))
    none = rows.where("i < 0")
    assert encoder.transform(none, **limits).count() == 0


def test_label_codes_are_ranks(spark):
    texts = ["芝", "ダ", "a", "ab", "abc", "", None, "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    fitted = encoders.fit_label_encoder(df, ["c"])
    got = [r["c"] for r in fitted.transform(df).orderBy("i").collect()]
    ranked = sorted({t if t is not None else "nan" for t in texts})
    assert got == [ranked.index(t if t is not None else "nan") for t in texts]
    assert fitted.transform(spark.createDataFrame([(0, "new")], "i int, c string")) \
        .first()["c"] == -1


def probabilities(ps, legs):
    total = {}
    for combo in itertools.permutations(ps, legs):
        p, left = 1.0, 1.0
        for i, h in enumerate(combo):
            p *= ps[h] if i == 0 else ps[h] / (left + 1e-9)
            left -= ps[h]
        total[combo] = p
    return total


@pytest.mark.parametrize("legs, ordered, unordered", [(2, "exacta", "quinella"),
                                                      (3, "trifecta", "trio")])
def test_ticket_probabilities(spark, legs, ordered, unordered):
    ps = {1: 0.5, 2: 0.2, 3: 0.2, 4: 0.1}
    names = ("h1", "h2", "h3")[:legs]
    want = probabilities(ps, legs)
    listed = spark.createDataFrame([("r", *c) for c in want] + [("r", *[1] * legs)],
                                   "race_id string, " + ", ".join(f"{n} int" for n in names))
    entrants = spark.createDataFrame([("r", h, p) for h, p in ps.items()],
                                     "race_id string, horse_num int, pred_prob double")
    out = tickets.with_ticket_probabilities(listed, entrants, legs=names)
    got = {tuple(r[n] for n in names): r for r in out.collect()}
    for combo, p in want.items():
        assert got[combo][ordered] == pytest.approx(p)
        same = sum(q for c, q in want.items() if set(c) == set(combo))
        assert got[combo][unordered] == pytest.approx(same)
    assert got[(1,) * legs][ordered] is None
    assert sum(want.values()) == pytest.approx(1.0, abs=1e-6)
    sets = tickets.combined_by_set(out.where(F.col(ordered).isNotNull()), legs=names,
                                   value=ordered)
    assert sets.agg(F.sum(ordered)).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_allocation_is_optimal(spark):
    rng = random.Random(9)
    data, budget = [], 1000.0
    for c in range(60):
        for h in range(3):
            odds = rng.choice([1.0, 2.0, 3.0, 6.0, 12.0])
            data.append((f"c{c}", h, rng.randrange(1, 10) / 10, odds))
    df = spark.createDataFrame(data, "race_id string, horse_num int, prob double, odds double")
    out = policy.allocate(df, budget, unit=1).collect()
    spent = {}
    for r in out:
        assert 0 < r["stake"] <= r["bound"] + 1e-9 and r["ev"] > 1.5
        spent[r["race_id"]] = spent.get(r["race_id"], 0) + r["stake"]
    assert max(spent.values()) <= budget + 1e-6
    for c in {d[0] for d in data}:
        mine = [(p * o - 1, budget * max(0, (p * o - 1) / (o - 1) * .25)) for k, _, p, o in data
                if k == c and p * o > 1.5]
        best = 0.0
        for order in itertools.permutations(mine):  # some order of filling is optimal
            left, value = budget, 0.0
            for gain, bound in order:
                x = min(bound, left)
                left, value = left - x, value + x * gain
            best = max(best, value)
        got = sum((r["ev"] - 1) * r["stake"] for r in out if r["race_id"] == c)
        assert got == pytest.approx(best, abs=2.0)  # amounts below half a unit drop out


def test_rounding_is_half_even_in_units(spark):
    df = spark.createDataFrame([("r", 1, 0.6, 3.0)],
                               "race_id string, horse_num int, prob double, odds double")
    assert policy.allocate(df, 2500.0).first()["amount"] == 200  # bound 250


def test_strict_and_inclusive_limits(spark):
    df = spark.createDataFrame([
        ("r", 1, 0.02, 100.0, 1), ("r", 2, 0.05, 100.0, 1), ("r", 3, 0.3, 20.0, 1),
        ("r", 4, 0.3, 4.0, 2), ("r", 5, 0.5, None, 1)],
        "race_id string, horse_num int, pred_prob double, odds double, rank int")
    bets = {r["horse_num"] for r in policy.decide_bets(df, min_ev=1.2).collect()}
    assert bets == {2, 3}  # 1.2 is not above 1.2; 0.05 and 100 are still allowed
    found = {(r["scenario"], r["horse_num"]) for r in policy.scenario_bets(df).collect()}
    assert ("Longshot (Odds>20)", 3) in found and ("Confident (Prob>0.3)", 3) in found
    assert ("Standard (EV>1.2)", 4) not in found


def test_tiers(spark):
    df = spark.createDataFrame([(0.5, 4.6), (0.5, 3.0), (0.5, 2.4), (0.5, 2.0), (0.04, 90.0),
                                (0.5, 101.0), (0.5, None)], "pred_prob double, odds double")
    got = [r["rec"] for r in policy.with_tier(df).collect()]
    assert got == ["◎", "○", "△", "", "", "", ""]


def test_scenarios_without_bets(spark):
    df = spark.createDataFrame([(0.1, 2.0, 1)], "pred_prob double, odds double, rank int")
    rows = evaluate.scenario_summary(df).collect()
    assert len(rows) == 7 and all(r["total_bet"] == 0 and r["recovery_pct"] == 0 for r in rows)


def test_total_is_the_sum_of_years(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(2020 + i % 3, rng.random(), 1 + rng.random() * 9, i % 4)
                                for i in range(200)],
                               "year int, pred_prob double, odds double, rank int")
    rows = evaluate.yearly_money(df, 1.0).collect()
    total = [r for r in rows if r["is_total"]][0]
    for c in ("raw_bet", "raw_ret", "filtered_bet", "filtered_ret"):
        assert total[c] == pytest.approx(sum(r[c] for r in rows if not r["is_total"]))


def test_best_threshold_takes_the_first_of_equals(spark):
    grid = spark.createDataFrame([(1.0, 100, 80.0), (1.1, 100, 90.0), (1.2, 100, 90.0),
                                  (1.3, 0, 0.0)], "threshold double, bet int, recovery double")
    assert evaluate.best_threshold(grid).first()["threshold"] == 1.1
    assert evaluate.best_threshold(grid.where("bet = 0")).first()["threshold"] == 0.0


def test_auc_with_ties(spark):
    rng = random.Random(6)
    data = [(int(rng.random() < .4), rng.randrange(30) / 30) for _ in range(400)]
    df = spark.createDataFrame(data, "target int, pred_prob double")
    pos = [p for t, p in data if t]
    neg = [p for t, p in data if not t]
    want = sum((a > b) + .5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.roc_auc(df, piece_rows=5).first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_median(spark, n):
    rng = random.Random(n)
    xs = [rng.choice([1.0, 5.0, rng.random() * 10]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    import statistics
    assert profile.exact_median(df, "x").first()[0] == pytest.approx(statistics.median(xs))


def test_settlement_states(spark):
    bets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "race_id string, horse_num int")
    res = spark.createDataFrame([("a", 2, 450)],
                                "race_id string, win_horse_num int, win_payout int")
    settled = joins.settle(bets, res)
    got = {(r["race_id"], r["horse_num"]): (r["status"], r["returned"])
           for r in settled.collect()}
    assert got == {("a", 1): ("LOSE", 0), ("a", 2): ("WIN", 450), ("b", 1): ("SKIP", 0)}
    total = evaluate.daily_summary(settled).first()
    assert (total["bets"], total["cost"], total["recovery"]) == (2, 200, 225.0)


def test_two_tier_join_never_multiplies(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "z", 1), (4, None, 1)],
                                 "i int, id string, day int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 3, 12)],
                                  "rid string, rday int, v int")
    out = joins.with_two_tier_match(left, right, {"id": "rid", "day": "rday"}, {"id": "rid"},
                                    ["v"], ["rday", "v"]).orderBy("i").collect()
    assert [(r["v"], r["match_tier"]) for r in out] == [
        (10, "exact"), (10, "coarse"), (None, "none"), (None, "none")]


def test_two_tier_join_takes_first_rows_also_of_large_keys(spark):
    left = spark.createDataFrame(
        [(i, [None, "a", "b", "c"][i % 4], i % 5 or None, i % 3) for i in range(60)],
        "i int, id string, day int, year int")
    right = spark.createDataFrame(
        [("abd"[i % 3] if i % 7 else None, i % 11 or None, i % 4, None if i % 9 == 1 else i, i)
         for i in range(40)], "rid string, rday int, ryear int, t int, v int")
    exact, coarse = {"id": "rid", "day": "rday"}, {"id": "rid", "year": "ryear"}
    have = [tuple(r) for r in right.collect()]

    def first(**same):
        fits = [r for r in have if all(x is not None and r[k] == x for k, x in
                                       zip((0, 1 if "day" in same else 2), same.values(),
                                           strict=True))]
        return min(fits, key=lambda r: (r[3] is None, r[3] or 0))[4] if fits else None

    expected = {}
    for i, key, day, year in map(tuple, left.collect()):
        one, two = first(id=key, day=day), first(id=key, year=year)
        expected[i] = (one, "exact") if one is not None else (two, "coarse") \
            if two is not None else (None, "none")
    for limit in (1, 10, 100):  # all keys, some keys, no key by a join per tier
        out = joins.with_two_tier_match(left, right, exact, coarse, ["v"], ["t", "v"], limit)
        assert {r["i"]: (r["v"], r["match_tier"]) for r in out.collect()} == expected
        assert out.count() == 60


def test_two_tier_join_moves_each_side_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100).selectExpr("id AS k", "id AS d", "id AS y")
        right = spark.range(100).selectExpr("id AS k2", "id AS d2", "id AS y2", "id AS v")
        out = joins.with_two_tier_match(left, right, {"k": "k2", "d": "d2"},
                                        {"k": "k2", "y": "y2"}, ["v"], ["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_isotonic_fit_over_ranges_equals_the_plain_fit(spark):
    rows = [(float((i * 7919) % 3001), int((i * 104729) % 3001 < (i * 7919) % 3001))
            for i in range(6000)] + [(None, 1), (5.0, None)]
    known = [r for r in rows if None not in r]
    falling = [(float(i), int(i < 300)) for i in range(600)]
    rising = [(float(i), int(i > 300)) for i in range(600)]
    for sample, given in ((known, rows), (falling, falling), (rising, rising)):
        df = spark.createDataFrame(given, "_raw double, target int")
        plain = IsotonicRegression(featuresCol="_raw", labelCol="y").fit(
            spark.createDataFrame([(x, float(y)) for x, y in sample], "_raw double, y double"))
        found = training.fit_calibration(df, "target", piece_points=150)
        assert list(found.boundaries) == list(plain.boundaries)
        assert list(found.predictions) == pytest.approx(list(plain.predictions))


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "rank int, horse_id string, age double")
    assert feat.model_columns(df) == ["age"]
    assert schemas.existing(df, ["age", "x", "rank"]) == ["age", "rank"]
    with pytest.raises(ValueError, match="odds"):
        schemas.require_columns(df, ["rank", "odds"])
    row = feat.aligned(df, ["age", "new"]).first()
    assert row["new"] == -999.0 and row["age"] == 2.0


def test_model_finds_a_planted_signal(spark):
    df = spark.createDataFrame([(f"r{i}", i, float(i % 10), float(i % 7), int(i % 10 > 6))
                                for i in range(600)],
                               "race_id string, horse_num int, x double, y double, target int")
    model = training.fit_calibrated(df, ["x", "y"], folds=3, maxIter=2, maxDepth=2)
    scored = model.transform(df)
    assert evaluate.roc_auc(scored).first()["auc"] > 0.95
    assert scored.columns == ["race_id", "horse_num", "target", "x", "y", "pred_prob"]
    assert training.importance_table(model, df).first()["feature"] == "x"


def test_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", i, float(i % 10), int(i % 10 > 6)) for i in range(200)],
                               "race_id string, horse_num int, x double, target int")
    model = training.fit_calibrated(df, ["x"], folds=2, maxIter=1, maxDepth=2)
    model.save(str(tmp_path / "m"))
    again = training.CalibratedModel.load(str(tmp_path / "m"), ["x"], folds=2)
    pick = lambda m: [r[0] for r in m.transform(df).orderBy("horse_num")
                      .select("pred_prob").collect()]
    assert pick(model) == pick(again)
