"""Scalar functions on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from formline.functions import scalars as S


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("text, expected", [
    ("1/2", 0.5), ("ハナ", 0.05), ("大差", 10.0), ("1 1/4", 1.25), ("同着", 0.0),
    ("クビ", 0.2), ("アタマ", 0.1), ("3", 3.0), ("2.5", 2.5), ("取消", None), (None, None),
    ("1/0", None), ("a/b", None)])
def test_margin(spark, text, expected):
    assert values(spark, S.margin_lengths("x"), [text]) == [expected]


def test_clock(spark):
    got = values(spark, S.clock_seconds("x"), ["1:35.5", "58.5", "x", None, "1:x"])
    assert got == [95.5, 58.5, None, None, None]


def test_running_style(spark):
    got = values(spark, S.running_style("x"),
                 ["1-1", "2-2", "10-10-9", "3-12", "", None, "5-x"])
    assert got == ["Nigeru", "Senko", "Sashi", "Oikomi", "Unknown", "Unknown", "Unknown"]


def test_positions_skip_junk(spark):
    texts = ["10-8-9", "x-4-(2", "", None]
    assert values(spark, S.first_position("x"), texts) == [10, 4, None, None]
    assert values(spark, S.final_position("x"), texts) == [9, 4, None, None]


def test_dates(spark):
    got = values(spark, S.event_date("x").cast("date").cast("string"),
                 ["2018年12月5日", "2018-12-15", "x", None, "2018年13月1日",
                  "2023年1月5日(木)"])
    assert got == ["2018-12-05", "2018-12-15", None, None, None, "2023-01-05"]


def test_vendor_date(spark):
    df = spark.createDataFrame([(15, 3, 1), (99, 12, 31), (15, 2, 30), (None, 1, 1)],
                               "y int, m int, d int")
    got = [str(r[0]) for r in df.select(S.vendor_date("y", "m", "d")).collect()]
    assert got == ["2015-03-01", "1999-12-31", "None", "None"]


def test_contest_titles(spark):
    got = values(spark, S.contest_title("x"), ["202509050101", "202599050101"])
    assert got == ["阪神5回1日 第1R", "不明5回1日 第1R"]
    got = values(spark, S.report_title("x"), ["202555050111", "202599050101"])
    assert got == ["園田 第11R", "不明(99) 第1R"]


def test_ids(spark):
    assert values(spark, S.canonical_id("x"), ["01088", "123.0", "5.05"]) == [
        "01088", "123", "5.05"]


def test_categories(spark):
    got = values(spark, S.distance_category("x"), [1399, 1400, 1800, 2200, None], "int")
    assert got == ["Sprint", "Mile", "Intermediate", "Long", "Unknown"]
    got = values(spark, S.weight_bin("x"), [439, 440, 480, 520, None], "int")
    assert got == ["Light", "Medium", "Heavy", "SuperHeavy", "Unknown"]


def test_bins(spark):
    labels = ("a", "b")
    got = values(spark, S.left_closed_bin("x", (1, 2, 5), labels),
                 [0.5, 1.0, 2.0, 5.0, None], "double")
    assert got == [None, "a", "b", None, None]
    got = values(spark, S.right_closed_bin("x", (0, 5), ("n", "m", "p")),
                 [-1.0, 0.0, 0.1, 5.0, 5.1, None], "double")
    assert got == ["n", "n", "m", "m", "p", None]


def test_body_weight(spark):
    weight, change = S.body_weight("x")
    texts = ["480(+2)", "480(0)", "計不", "478(前計不)", "480", None]
    assert values(spark, weight, texts) == [480, 480, None, 478, None, None]
    assert values(spark, change, texts) == [2, 0, None, 0, None, None]


def test_keys_and_flags(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    assert df.select(S.joined_key("a", "b")).first()[0] == "a_unknown"
    assert values(spark, S.is_winner("x"), [1, 2, None], "int") == [1, 0, 0]
    assert values(spark, S.within("x", 2), [1, 3, None], "int") == [1, 0, None]


def test_kelly(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.5, 1.0), (0.1, 2.0), (0.9, 0.5)],
                               "p double, o double")
    got = [r[0] for r in df.select(S.kelly_fraction("p", "o")).collect()]
    assert got == pytest.approx([0.25, 0.0, -0.8, 0.0])


def test_codes(spark):
    assert values(spark, S.style_code("x"), ["逃げ", "中団", "?", None]) == [1, 3, 0, 0]
    assert values(spark, S.course_code_of_name("x"), ["小倉", "門別"]) == ["10", None]
    assert values(spark, F.round(S.month_cycle("x")[0], 6), ["2023-01-05"]) == [0.5]
