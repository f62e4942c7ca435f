"""Cases of the second round: each expectation is written from the source's rule."""

import csv

import pytest
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators import encoders, evaluate, history, joins
from formline.plans import training
from formline.sources import html, tables

GOOD = """<html><body><table summary="コーナー通過順位">
<tr><th>1コーナー</th><td>3,1,2</td></tr><tr><th>2コーナー</th><td>1,2,3</td></tr>{more}</table>
<table summary="コーナー通過順位"><tr><th>3コーナー</th><td>9</td></tr></table></body></html>"""


def test_repeated_corner_label_costs_nothing(spark):
    pages = [("a", GOOD.format(more="")),
             ("b", GOOD.format(more="<tr><th>1コーナー</th><td>2,2,2</td></tr>")), ("c", "<p>")]
    df = html.parsed_pages(spark.createDataFrame(pages, "race_id string, html string"))
    got = {r.race_id: r.m for r in df.select("race_id", html.corner_map(
        F.col("p")["rows"]).alias("m")).collect()}
    assert got == {"a": {"corner_1コーナー": "3,1,2", "corner_2コーナー": "1,2,3"},
                   "b": {"corner_1コーナー": "2,2,2", "corner_2コーナー": "1,2,3"}, "c": {}}


def write(path, header, rows, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f).writerows([header, *rows])


def test_csv_files_go_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", ["race_id", "odds", "horse_num"], [["01", "2.5", "3"]])
    write(tmp_path / "b.csv", ["odds", "race_id"], [["7.5", "02"], ["odds", "03"]])
    df = tables.read_csv(spark, str(tmp_path / "*.csv"), "race_id string, horse_num int, odds double")
    assert df.columns == ["race_id", "horse_num", "odds"]
    assert sorted(map(tuple, df.collect())) == [("01", 3, 2.5), ("02", None, 7.5),
                                                ("03", None, None)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no data"):
        tables.read_csv(spark, str(tmp_path / "empty"))


def test_legacy_files_go_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", ["場所", "PCI"], [["東京", "50.5"]], "cp932")
    write(tmp_path / "b.csv", ["PCI", "場所"], [["60", "中山"]], "cp932")
    df = tables.read_legacy_csv(spark, str(tmp_path / "*.csv"), "`場所` string, PCI double")
    assert sorted(map(tuple, df.collect())) == [("中山", 60.0), ("東京", 50.5)]


def test_bad_vendor_dates_are_null(spark):
    rows = [("24", "1", "5"), ("x", "1", "5"), ("24", "?", "5"), ("24", "2", "30"),
            (None, "1", "1"), ("49", "1", "1"), ("50", "1", "1")]
    df = spark.createDataFrame(rows, "y string, m string, d string")
    got = [str(r[0]) for r in df.select(S.vendor_date("y", "m", "d")).collect()]
    assert got == ["2024-01-05", "None", "None", "None", "None", "2049-01-01", "1950-01-01"]


def test_joined_columns_of_a_taken_name_get_a_suffix(spark):
    left = spark.createDataFrame([(1, "l"), (2, "l")], "k int, odds string")
    right = spark.createDataFrame([(1, "r", 5), (1, "s", 4)], "k2 int, odds string, t int")
    out = joins.with_exact_match(left, right, {"k": "k2"}, ["odds"], ["t"])
    assert out.columns == ["k", "odds", "odds_jv_dup"]
    assert sorted(map(tuple, out.collect())) == [(1, "l", "s"), (2, "l", None)]
    two = joins.with_two_tier_match(left, right, {"k": "k2"}, {"k": "k2"}, ["odds"], ["t"])
    assert two.columns == ["k", "odds", "odds_jv_dup", "match_tier"]


def test_calibration_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.2, 0), (0.25, 1), (1.0, 1), (None, 1)],
                               "pred_prob double, target int")
    got = {r.bin: (r.mean_pred, r.fraction_pos, r.n)
           for r in evaluate.calibration_table(df).collect()}
    assert got[0] == (pytest.approx(0.05), 0.5, 1)
    assert got[1] == (0.2, 0.0, 1) and got[2] == (0.25, 1.0, 2) and got[9] == (1.0, 1.0, 1)


def test_label_column_without_fitted_values_is_unseen(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "weather string, gender string")
    encoder = encoders.fit_label_encoder(df.select("weather"), ["weather"])
    encoder.columns.append("gender")
    assert sorted(map(tuple, encoder.transform(df).collect())) == [(0, -1), (1, -1)]


def test_label_ranks_of_one_common_prefix(spark):
    values = [(f"the same long prefix of all the values {i:04d}",) for i in range(300)]
    df = spark.createDataFrame(values, "weather string")
    got = {r.key: r.code for r in encoders.fit_labels(df, ["weather"]).collect()}
    assert got == {v[0]: i for i, v in enumerate(sorted(values))}


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(1000)], "k int, y boolean")
    got = {r.y: (r.n, r.t) for r in training.stratified_split(df, "y", ["k"]).groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()}
    assert got == {True: (143, 114), False: (857, 686)}


def test_stratified_split_of_repeated_and_missing_keys(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (None, 0, "a"), (None, 1, "b"), (None, 1, "b"),
            (2, None, "x")] * 50
    df = spark.createDataFrame(rows, "k int, y int, is_other string")
    for piece_rows in (250_000, 20):
        found = training.stratified_split(df, "y", ["k"], piece_rows=piece_rows)
        assert found.columns == ["k", "y", "is_other", "is_train"] and found.count() == len(rows)
        got = {r.y: (r.n, r.t) for r in found.groupBy("y").agg(
            F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()}
        assert got == {0: (150, 120), 1: (100, 80), None: (50, 40)}
    none = training.stratified_split(df.limit(0), "y", ["k"])
    assert none.count() == 0


def test_stratified_split_spreads_the_rows_of_a_label(spark):
    df = spark.range(4000).select(F.lit("p" * 100).alias("prefix"), "id", F.lit(1).alias("y"))
    found = training.stratified_split(df, "y", ["prefix", "id"], piece_rows=250)
    assert found.where("is_train").count() == 3200
    # The split is the same whatever the order and the partitions of the rows.
    again = training.stratified_split(df.orderBy(F.desc("id")).repartition(3), "y",
                                      ["prefix", "id"], piece_rows=900)
    assert found.exceptAll(again).count() == 0


def test_decayed_means_use_rows_of_any_age(spark):
    """A huge value 400 rows back still moves the mean; with its weight cut it would not."""
    values = [1e80, *[None] * 400, 1.0, 2.0, None, 5.0]
    df = spark.createDataFrame([("h", i, v) for i, v in enumerate(values)],
                               "k string, t long, x double")
    o = history.OrderedRows(df, ["k"], ["t"], halo=history.decay_rows(5))
    got = [r.m for r in o.finish(history.with_decayed_means(o, {"m": "x"})).orderBy("t").collect()]
    for i in range(1, len(values)):
        known = [(v, (2 / 3) ** (i - j)) for j, v in enumerate(values[:i]) if v is not None]
        plain = sum(v * w for v, w in known) / sum(w for _, w in known)
        assert got[i] == pytest.approx(plain, rel=1e-9)


def test_vendor_values_without_dates(spark):
    from formline.plans import features
    vendor = spark.createDataFrame(
        [("7", "2024-01-01", "05", 1, 1.0, "a"), ("7", "2024-02-01", "05", 2, None, "b")],
        "horse_id_jv string, date_jv string, place_code_jv string, `レース番号` int, "
        "prev_pci double, sire_type string").withColumn("date_jv", F.col("date_jv").cast("date"))
    df = spark.createDataFrame([("7.0", 3), ("8", 4)], "horse_id string, horse_num int")
    got = sorted(features.with_vendor(df, vendor).select(
        "horse_num", "prev_pci", "sire_type").collect())
    assert list(map(tuple, got)) == [(3, 1.0, "b"), (4, None, None)]
