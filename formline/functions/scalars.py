"""Scalar column functions: ids, dates, text fields, categories, bins, prices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Course code -> name, central courses.
CENTRAL_COURSES = {
    "01": "札幌", "02": "函館", "03": "福島", "04": "新潟", "05": "東京",
    "06": "中山", "07": "中京", "08": "京都", "09": "阪神", "10": "小倉",
}
# Course code -> name, local courses.
LOCAL_COURSES = {
    "30": "門別", "31": "盛岡", "32": "水沢", "33": "浦和", "34": "船橋", "35": "大井",
    "36": "川崎", "42": "金沢", "43": "笠松", "44": "名古屋", "45": "園田", "46": "姫路",
    "47": "高知", "48": "佐賀", "50": "帯広", "51": "ばんえい", "54": "名古屋",
    "55": "園田", "56": "姫路",
}
# Course code -> romanised name.
COURSE_ROMAN = {
    "01": "Sapporo", "02": "Hakodate", "03": "Fukushima", "04": "Niigata", "05": "Tokyo",
    "06": "Nakayama", "07": "Chukyo", "08": "Kyoto", "09": "Hanshin", "10": "Kokura",
}
# Margin word -> lengths.
MARGIN_WORDS = {"同着": 0.0, "ハナ": 0.05, "アタマ": 0.1, "クビ": 0.2, "大差": 10.0}
# Vendor running-style word -> code.
STYLE_CODES = {"逃げ": 1, "ﾏｸﾘ": 1, "先行": 2, "差し": 3, "追込": 4, "中団": 3, "後方": 4}
JAPANESE_DATE = "yyyy年M月d日"
# ----------------------------------------------------------------------------------

CENTRAL_CODES = sorted(CENTRAL_COURSES)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, or ``default``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), col(c)), F.lit(default))


def number(c: str | Column) -> Column:
    """Number of a text field; anything unreadable becomes NULL."""
    return col(c).try_cast("double")


# --- contest ids ------------------------------------------------------------------

def place_code(contest: str | Column) -> Column:
    return F.substring(col(contest).cast("string"), 5, 2)


def contest_parts(contest: str | Column, names: dict | None = None,
                  tell_code: bool = False) -> Column:
    """Struct of the parts of a ``YYYYCCKKDDRR`` id."""
    text, code = col(contest).cast("string"), place_code(contest)
    unknown = F.concat(F.lit("不明("), code, F.lit(")")) if tell_code else F.lit("不明")

    def two(start):
        return F.substring(text, start, 2).try_cast("int")

    return F.struct(
        F.substring(text, 1, 4).alias("year"),
        code.alias("course_code"),
        two(7).alias("kai"),
        two(9).alias("day"),
        two(11).alias("race_num"),
        F.coalesce(lookup(code, names or CENTRAL_COURSES), unknown).alias("course_name"),
    )


def contest_title(contest: str | Column) -> Column:
    p = contest_parts(contest)
    return F.concat(p["course_name"], p["kai"].cast("string"), F.lit("回"),
                    p["day"].cast("string"), F.lit("日 第"),
                    p["race_num"].cast("string"), F.lit("R"))


def report_title(contest: str | Column) -> Column:
    p = contest_parts(contest, {**CENTRAL_COURSES, **LOCAL_COURSES}, tell_code=True)
    return F.concat(p["course_name"], F.lit(" 第"), p["race_num"].cast("string"), F.lit("R"))


def canonical_id(c: str | Column) -> Column:
    """Id as text; ``123.0`` and ``123`` are the same id."""
    return F.regexp_replace(col(c).cast("string"), r"\.0$", "")


# --- dates ------------------------------------------------------------------------

def event_date(c: str | Column) -> Column:
    """Timestamp of a Japanese or ISO date text; NULL if neither fits."""
    text = F.trim(col(c).cast("string"))
    found = F.regexp_extract(text, r"(\d{4}年\d{1,2}月\d{1,2}日)", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit(JAPANESE_DATE)),
                      text.try_cast("timestamp"))


def strict_japanese_date(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c).cast("string"), F.lit(JAPANESE_DATE))


def vendor_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Date from two-digit year parts; years below 50 belong to this century."""
    y, m, d = (col(c).try_cast("int") for c in (year, month, day))
    full = F.when(y < 50, y + 2000).otherwise(y + 1900)
    text = F.format_string("%04d-%02d-%02d", full, m, d)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def month_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def month_cycle(c: str | Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.month(col(c)) / 12
    return F.sin(angle), F.cos(angle)


# --- text fields ------------------------------------------------------------------

def clock_seconds(c: str | Column) -> Column:
    """Seconds of ``m:ss.s`` or ``ss.s``."""
    parts = F.split(col(c), ":")
    first, second = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2))
    return F.when(F.size(parts) == 2, first * 60 + second.try_cast("double")).otherwise(first)


def margin_lengths(c: str | Column) -> Column:
    """Lengths of a margin text: word, number, ``a/b`` or ``n a/b``."""
    text = F.trim(col(c))
    pattern = r"^(?:(\d+(?:\.\d+)?)\s+)?(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)$"

    def part(i):
        return F.regexp_extract(text, pattern, i).try_cast("double")

    fraction = F.coalesce(part(1), F.lit(0.0)) + F.try_divide(part(2), part(3))
    return F.coalesce(lookup(text, MARGIN_WORDS),
                      F.when(text.contains("/"), fraction).otherwise(text.try_cast("double")))


def passing_positions(c: str | Column) -> Column:
    """Integers of a passing order such as ``10-10-9``; junk parts are skipped."""
    return F.filter(F.transform(F.split(col(c), "-"), lambda p: F.trim(p).try_cast("int")),
                    lambda p: p.isNotNull())


def first_position(c: str | Column) -> Column:
    return F.try_element_at(passing_positions(c), F.lit(1))


def final_position(c: str | Column) -> Column:
    return F.try_element_at(passing_positions(c), F.lit(-1))


def running_style(c: str | Column) -> Column:
    """Style by the last passing position."""
    last = F.trim(F.try_element_at(F.split(col(c), "-"), F.lit(-1))).try_cast("int")
    return (F.when(last.isNull(), "Unknown").when(last == 1, "Nigeru")
            .when(last <= 4, "Senko").when(last <= 9, "Sashi").otherwise("Oikomi"))


def style_code(c: str | Column) -> Column:
    return lookup(c, STYLE_CODES, 0)


def course_code_of_name(c: str | Column) -> Column:
    return lookup(c, {name: code for code, name in CENTRAL_COURSES.items()})


def body_weight(c: str | Column) -> tuple[Column, Column]:
    """(weight, change) of ``480(+2)``; an unreadable change counts as 0."""
    pattern = r"(\d+)\((.+)\)"
    weight = F.regexp_extract(col(c), pattern, 1).try_cast("int")
    change = F.regexp_extract(col(c), pattern, 2).try_cast("int")
    return weight, F.when(weight.isNotNull(), F.coalesce(change, F.lit(0)))


# --- categories and bins ----------------------------------------------------------

def steps(c: str | Column, edges: Sequence[tuple[float, str]], last: str,
          missing: str | None) -> Column:
    value = col(c)
    label = F.when(value.isNull(), F.lit(missing))
    for edge, name in edges:
        label = label.when(value < edge, name)
    return label.otherwise(last)


def distance_category(c: str | Column) -> Column:
    return steps(c, [(1400, "Sprint"), (1800, "Mile"), (2200, "Intermediate")], "Long",
                 "Unknown")


def weight_bin(c: str | Column) -> Column:
    return steps(c, [(440, "Light"), (480, "Medium"), (520, "Heavy")], "SuperHeavy",
                 "Unknown")


def left_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of ``[edge, next edge)``; NULL outside."""
    value = col(c)
    label = F.when(value < edges[0], None)
    for edge, name in zip(edges[1:], labels, strict=True):
        label = label.when(value < edge, name)
    return label


def right_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of ``(edge, next edge]`` with open ends on both sides."""
    value = col(c)
    label = F.when(value.isNull(), None)
    for edge, name in zip(edges, labels[:-1], strict=True):
        label = label.when(value <= edge, name)
    return label.otherwise(labels[-1])


def joined_key(*parts: str | Column, missing: str = "unknown") -> Column:
    """``a_b`` interaction key; a NULL part reads as ``missing``."""
    return F.concat_ws("_", *[F.coalesce(col(p).cast("string"), F.lit(missing))
                              for p in parts])


# --- outcome flags, value, stakes -------------------------------------------------

def within(position: str | Column, limit: int) -> Column:
    """1/0 flag of a position up to ``limit``; NULL positions stay NULL."""
    return (col(position) <= limit).cast("int")


def is_winner(position: str | Column) -> Column:
    """1 for position 1, 0 otherwise, also for a missing position."""
    return F.when(col(position) == 1, 1).otherwise(0)


def log1p0(c: str | Column) -> Column:
    return F.log1p(F.coalesce(col(c).cast("double"), F.lit(0.0)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def expected_value(prob: str | Column, price: str | Column) -> Column:
    """Probability times price; 0 without a price."""
    return F.coalesce(col(prob) * col(price), F.lit(0.0))


def kelly_fraction(prob: str | Column, price: str | Column) -> Column:
    """(p*o - 1)/(o - 1), 0 where the price leaves no gain."""
    p, o = col(prob), col(price)
    return F.when(o > 1, F.try_divide(p * o - 1, o - 1)).otherwise(F.lit(0.0))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
