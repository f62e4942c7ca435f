"""Tables from saved HTML pages.

A small reader turns a page into its table rows and a few marked texts (the only Python
step, in Arrow batches); every field is then read by column expressions.
"""

from __future__ import annotations

import re
import sys
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S

# --- the page reader --------------------------------------------------------------

# Marked texts: field name -> chain of "tag" or "tag.class" from outer to inner element.
MARKS = {
    "smalltxt": ("div.data_intro", "p.smalltxt"),
    "racedata": ("div.data_intro", "dl.racedata"),
    "span": ("div.data_intro", "dl.racedata", "dd", "span"),
    "h1": ("h1",),
    "title": ("title",),
    "data01": ("div.RaceData01",),
    "data02": ("div.RaceData02", "span"),
}
CELL = ("struct<tag:string,cls:string,text:string,lines:array<string>,"
        "href:string,link:string>")
ROW = (f"struct<table_no:int,table_class:string,summary:string,block:string,row_no:int,"
       f"row_class:string,cells:array<{CELL}>>")
PAGE = (f"struct<{','.join(f'{m}:string' for m in MARKS)},"
        f"rows:array<{ROW}>,error:string>")
_CELL = pa.struct([("tag", pa.string()), ("cls", pa.string()), ("text", pa.string()),
                   ("lines", pa.list_(pa.string())), ("href", pa.string()),
                   ("link", pa.string())])
_ROW = pa.struct([("table_no", pa.int32()), ("table_class", pa.string()),
                  ("summary", pa.string()), ("block", pa.string()), ("row_no", pa.int32()),
                  ("row_class", pa.string()), ("cells", pa.list_(_CELL))])
_PAGE = pa.struct([*[(m, pa.string()) for m in MARKS], ("rows", pa.list_(_ROW)),
                   ("error", pa.string())])
_MARKS_AT = {}  # tag of the innermost element -> marks ending there
for _name, _chain in MARKS.items():
    _parts = [tuple(_part.partition(".")[::2]) for _part in reversed(_chain)]
    _MARKS_AT.setdefault(_parts[0][0], []).append((_name, _parts))
_EMPTY = {"br", "img", "meta", "input", "link", "hr", "col", "wbr", "area", "base"}
_SILENT = {"script", "style"}
_CLOSES = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}


# What most pages consist of: cells and links that hold a text only, tags, texts.  A page with
# anything else goes through ``HTMLParser``.
_ATTRIBUTES = r"(?:\s+[a-zA-Z][-a-zA-Z0-9_]*(?:=(?:\"[^\"<>]*\"|[a-zA-Z0-9]+))?)*\s*"
_PLAIN = re.compile(
    rf"(?:<t[dh]{_ATTRIBUTES}>[^<]*</t[dh]>|<a{_ATTRIBUTES}>[^<]*</a>"
    rf"|<(?:[a-zA-Z][a-zA-Z0-9]*{_ATTRIBUTES}|/[a-zA-Z][a-zA-Z0-9]*\s*|br\s*/)>)\s*|[^<]+")
_ATTRIBUTE = re.compile(r"\s([^\s=]+)(?:=(?:\"([^\"]*)\"|([a-zA-Z0-9]+)))?")
_ODD_REFERENCE = re.compile(r"&(?!(?:amp|lt|gt|quot|#[0-9]{1,6});)")
# Elements whose content is text to HTMLParser, whatever it looks like.
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes",
        "noscript", "plaintext", "svg", "math"}


_TAGS: dict[str, tuple[str, dict, list[str]]] = {}  # parts of the start tags met so far
TAGS_KEPT = 4096


def _tag_parts(token: str) -> tuple[str, dict, list[str]]:
    """(name, attributes, classes) of a plain start tag; not to be changed by the caller."""
    if token not in _TAGS:
        if len(_TAGS) >= TAGS_KEPT:
            _TAGS.clear()
        _TAGS[token] = _parts_of(token)
    return _TAGS[token]


def _parts_of(token: str) -> tuple[str, dict, list[str]]:
    tag = re.match(r"<([a-zA-Z0-9]+)", token)
    given = {m[1].lower(): None if m[2] is None and m[3] is None
             else unescape(m[2] if m[2] is not None else m[3])
             for m in _ATTRIBUTE.finditer(token, tag.end(), len(token) - 1)}
    return tag[1].lower(), given, (given.get("class") or "").split()


class _Open:
    """An element that is open."""
    __slots__ = ("tag", "classes", "given", "got", "marks", "row", "cell", "link_of", "no", "rows")

    def __init__(self, tag, classes, given):
        self.tag, self.classes, self.given = tag, classes, given
        self.got = self.marks = self.row = self.cell = self.link_of = None


class _PageReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._begin()

    def _begin(self):
        self.open = []
        self.takers, self.quiet = [], 0  # open elements whose text is wanted; scripts and styles
        self.rows, self.texts, self.tables = [], {}, 0
        self.open_tables, self.open_rows, self.open_cells, self.blocks = [], [], [], []

    def feed(self, data):
        if not self._feed_plain(data):
            self._begin()
            super().feed(data)

    def _feed_plain(self, data):
        """Read a page of plain tags and texts; False if it has anything else."""
        tokens = _PLAIN.findall(data)
        if sum(map(len, tokens)) != len(data):
            return False
        if tokens and tokens[-1][0] != "<" and "&" in tokens[-1]:
            return False  # a reference that may be unfinished
        raw, opened, open_rows = None, self.open, self.open_rows
        open_cells, takers = self.open_cells, self.takers
        for token in tokens:
            # Most of a page: cells without attributes and links with a target alone, as ``_whole``
            # reads them.
            if raw is None and not self.quiet:
                if token.startswith("<td>"):
                    end = token.rfind("</td>")
                    if end > 0:
                        text = token[4:end]
                        text = (unescape(text) if "&" in text else text).strip()
                        if opened and opened[-1].tag != "tr":
                            self._close_open(_CLOSES["td"])
                        if open_rows:
                            open_rows[-1]["cells"].append({
                                "tag": "td", "cls": "", "href": None, "link": None,
                                "text": text, "lines": [text] if text else []})
                        if text:
                            for e in takers:
                                e.got.append(text)
                        continue
                elif token.startswith('<a href="'):
                    quote, end = token.index('"', 9), token.rfind("</a>")
                    if end > 0 and token[quote + 1] == ">" and "&" not in token[9:quote]:
                        text = token[quote + 2:end]
                        text = (unescape(text) if "&" in text else text).strip()
                        cell = open_cells[-1] if open_cells else None
                        if cell is not None and cell["href"] is None:
                            cell["href"], cell["link"] = token[9:quote], text
                        if text:
                            for e in takers:
                                e.got.append(text)
                        continue
            if token[0] != "<":
                if self.takers and not self.quiet:
                    self.handle_data(unescape(token) if "&" in token else token)
                continue
            if token[-1] != ">":
                token = token.rstrip()
            if token[1] == "/":
                tag = token[2:-1].strip().lower()
                if raw is not None and tag != raw:
                    return False
                raw = None
                self._close(tag)
            elif raw is not None:
                return False
            elif token[-2] != "/":  # else a line break, which is no element
                end = token.index(">") + 1
                head = token[:end]
                if "&" in head and _ODD_REFERENCE.search(head):
                    return False
                tag, given, classes = _tag_parts(head)
                if end == len(token):
                    self._start(tag, given, classes)
                    if tag in _RAW:
                        raw = tag
                elif token[-2] != tag[-1]:
                    return False  # <td>..</th>
                else:
                    text = token[end:token.rindex("<")]
                    self._whole(tag, given, classes,
                                unescape(text) if "&" in text else text)
        return raw is None

    def _whole(self, tag, given, classes, data):
        """A cell or link that holds a text only, as if opened, filled and closed."""
        text = "" if self.quiet else data.strip()
        if tag == "a":
            cell = self.open_cells[-1] if self.open_cells else None
            if cell is not None and cell["href"] is None and given.get("href") is not None:
                cell["href"], cell["link"] = given["href"], text
        else:
            if self.open and self.open[-1].tag != "tr":  # nothing is left open right in a row
                self._close_open(_CLOSES[tag])
            if self.open_rows:
                self.open_rows[-1]["cells"].append({
                    "tag": tag, "cls": " ".join(classes), "href": None, "link": None,
                    "text": text, "lines": [text] if text else []})
        if text:
            for e in self.takers:
                e.got.append(text)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        self._start(tag, given, (given.get("class") or "").split())

    def _start(self, tag, given, classes):
        if tag in _EMPTY:
            return
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag])
        entry = _Open(tag, classes, given)
        self.open.append(entry)
        if tag in ("td", "th"):
            if self.open_rows:
                entry.cell = {"tag": tag, "cls": " ".join(classes), "href": None, "link": None}
                self.open_rows[-1]["cells"].append(entry.cell)
                self.open_cells.append(entry.cell)
        elif tag == "tr":
            self._start_row(entry)
        elif tag == "a":
            if given.get("href") is not None and self.open_cells:
                cell = self.open_cells[-1]
                if cell["href"] is None:
                    cell["href"], entry.link_of = given["href"], cell
        elif tag == "table":
            entry.no, entry.rows = self.tables, 0
            self.tables += 1
            self.open_tables.append(entry)
        elif tag in _SILENT:
            self.quiet += 1
        elif tag == "dl":
            self.blocks.append(entry)
        if tag in _MARKS_AT:
            # What stands around an element does not change while it is open.
            entry.marks = [name for name, chain in _MARKS_AT[tag]
                           if name not in self.texts and self._matches(chain)]
        if entry.marks or entry.cell is not None or entry.link_of is not None:
            entry.got = []
            self.takers.append(entry)

    def _start_row(self, entry):
        if not self.open_tables:
            return
        table = self.open_tables[-1]
        entry.row = {
            "table_no": table.no, "table_class": " ".join(table.classes),
            "summary": table.given.get("summary"),
            "block": " ".join(self.blocks[0].classes) if self.blocks else "",
            "row_no": table.rows, "row_class": " ".join(entry.classes), "cells": []}
        table.rows += 1
        self.rows.append(entry.row)
        self.open_rows.append(entry.row)

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag):
        """Close the innermost open ``tag``, and what is open inside it."""
        opened = self.open
        if opened and opened[-1].tag == tag:
            self._finish()
            return
        for i in range(len(opened) - 1, -1, -1):
            if opened[i].tag == tag:
                while len(opened) > i:
                    self._finish()
                return

    def _close_open(self, tags):
        """Close cells or rows of the innermost table that were left open."""
        outermost = None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i].tag
            if tag == "table":
                break
            if tag in tags:
                outermost = i
        while outermost is not None and len(self.open) > outermost:
            self._finish()

    def _finish(self):
        entry = self.open.pop()
        tag = entry.tag
        if entry.got is not None:
            self.takers.pop()  # takers are open elements, so this one is the innermost
            text = "".join(entry.got)
            for name in entry.marks or ():
                self.texts.setdefault(name, text)
            if entry.cell is not None:
                entry.cell["text"], entry.cell["lines"] = text, entry.got
                self.open_cells.pop()
            if entry.link_of is not None:
                entry.link_of["link"] = text
        if entry.row is not None:
            self.open_rows.pop()
        elif tag == "table":
            self.open_tables.pop()
        elif tag == "dl":
            self.blocks.pop()
        elif tag in _SILENT:
            self.quiet -= 1

    def _matches(self, chain):
        """The chain, from inner to outer, starts at the innermost open element."""
        tag, cls = chain[0]
        inner = self.open[-1]
        if inner.tag != tag or (cls and cls not in inner.classes):
            return False
        found = 1
        for e in reversed(self.open[:-1]):
            if found == len(chain):
                break
            tag, cls = chain[found]
            if e.tag == tag and (not cls or cls in e.classes):
                found += 1
        return found == len(chain)

    def handle_data(self, data):
        if self.takers and not self.quiet and (text := data.strip()):
            for e in self.takers:
                e.got.append(text)

    def page(self):
        while self.open:
            self._finish()
        return {**{m: self.texts.get(m) for m in MARKS}, "rows": self.rows, "error": None}


def read_page(html: str | None, references: bool = True) -> dict:
    """Rows and marked texts of one page; a page that cannot be read has only ``error``.

    Without ``references`` the character references of its texts stay as they are written.
    """
    try:
        reader = _PageReader()
        html = html or ""
        reader.feed(html if references else html.replace("&", "&amp;"))
        return reader.page()
    except Exception as e:  # noqa: BLE001 - a bad page must not end the job
        return {**dict.fromkeys(MARKS), "rows": [], "error": repr(e)}


PAGES_AT_ONCE = 100  # the Python objects of so many pages live at a time


def _read_some(html: pa.Array, references: bool = True) -> pa.Array:
    parts = [pa.array([read_page(h, references) for h in html[i:i + PAGES_AT_ONCE].to_pylist()],
                      type=_PAGE) for i in range(0, len(html), PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_PAGE)


def _read_batch(html: pa.Array) -> pa.Array:
    return _read_some(html)


def _read_batch_as_written(html: pa.Array) -> pa.Array:
    return _read_some(html, references=False)


def page_parts(html: str | Column, references: bool = True) -> Column:
    # Shipped by value, so executors need no installed copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    read = F.arrow_udf(_read_batch if references else _read_batch_as_written, PAGE)
    return read(html)


def parsed_pages(pages: DataFrame, key: str = "race_id", references: bool = True) -> DataFrame:
    return pages.select(key, page_parts("html", references).alias("p"))


def page_errors(pages: DataFrame, key: str = "race_id") -> DataFrame:
    """Pages that could not be read."""
    # A filter on the reader's column would be pushed below it and read every page twice.
    return parsed_pages(pages, key).select(key, F.explode(F.when(
        F.col("p.error").isNotNull(), F.array("p.error"))).alias("error"))


# --- helpers on rows --------------------------------------------------------------

def has_class(classes: Column, name: str) -> Column:
    return F.array_contains(F.split(classes, " "), name)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def first_table(rows: Column, name: str) -> Column:
    """Rows of the first table of a class."""
    mine = F.filter(rows, lambda r: has_class(r["table_class"], name))
    return F.filter(mine, lambda r: r["table_no"] == F.try_element_at(mine, F.lit(1))["table_no"])


def data_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: c["tag"] == "td")


def at(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def plain_number(text: Column) -> Column:
    """Unsigned decimal number, else NULL."""
    return F.when(text.rlike(r"^\d+\.?\d*$|^\.\d+$"), text.try_cast("double"))


def digits(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def sex_age(text: Column) -> tuple[Column, Column]:
    long_enough = F.length(text) >= 2
    return (F.when(long_enough, F.substring(text, 1, 1)),
            F.when(long_enough, digits(F.substring(text, 2, 9))))


def turn(text: Column) -> Column:
    return (F.when(text.contains("右"), "右").when(text.contains("左"), "左")
            .when(text.contains("直"), "直").otherwise("Unknown"))


# --- result pages -----------------------------------------------------------------

def contest_columns(p: Column) -> dict[str, Column]:
    """Date, surface, distance, weather and track condition of a result page."""
    small, span, data = p["smalltxt"], p["span"], p["racedata"]
    course, fallback = r"\((芝|ダ|障).+?(\d+)\)", r"(芝|ダ|障).+?(\d+)m"
    from_small = found(small, course)
    turf, dirt = found(data, r"芝\s*:\s*(\S+)"), found(data, r"ダート\s*:\s*(\S+)")
    return {
        "date": found(small, r"(\d+年\d+月\d+日)"),
        "surface": F.coalesce(from_small, found(span, fallback)),
        "distance": F.when(from_small.isNotNull(), found(small, course, 2))
        .otherwise(found(span, fallback, 2)).try_cast("int"),
        "weather": found(data, r"天候\s*:\s*(\S+)"),
        "condition": F.when(data.contains("芝"), turf).otherwise(dirt),
    }


def more_contest_columns(p: Column, contest: str = "race_id") -> dict[str, Column]:
    """Direction, class and romanised place, as the older pages give them."""
    small, code = p["smalltxt"], S.place_code(contest)
    twelve = F.length(contest) == 12
    by_course = found(small, r"\((芝|ダ|障).+?(\d+)\)").isNotNull()
    return {
        "around": F.when(small.isNotNull() & (by_course | p["span"].isNull()), turn(small))
        .when(p["span"].isNotNull(), turn(p["span"])),
        "race_class": F.coalesce("p.h1", F.lit("Unknown")),
        "place": F.when(twelve, S.lookup(code, S.COURSE_ROMAN, "Unknown")).otherwise("Unknown"),
    }


def first_summary(rows: Column, summary: str) -> Column:
    """Rows of the first table with a summary text."""
    mine = F.filter(rows, lambda r: r["summary"] == summary)
    return F.filter(mine, lambda r: r["table_no"] == F.try_element_at(mine, F.lit(1))["table_no"])


def corner_map(rows: Column) -> Column:
    """Corner label -> passing text of the first corner table; a repeated label's last one."""
    mine = first_summary(rows, "コーナー通過順位")

    def cell(r, tag):
        return F.try_element_at(F.filter(r["cells"], lambda c: c["tag"] == tag), F.lit(1))

    both = F.filter(mine, lambda r: cell(r, "th").isNotNull() & cell(r, "td").isNotNull())
    pairs = F.transform(both, lambda r: F.named_struct(
        F.lit("key"), F.concat(F.lit("corner_"), cell(r, "th")["text"]),
        F.lit("value"), cell(r, "td")["text"]))
    named = F.filter(pairs, lambda r: r["key"].isNotNull())
    # The position of a label's last row is that of its first one in the reversed list.
    back = F.reverse(named)
    labels = F.transform(back, lambda r: r.getField("key"))
    return F.map_from_entries(F.filter(back, lambda r, i: F.array_position(
        labels, r.getField("key")) == i + 1))


def lap_text(rows: Column) -> Column:
    mine = first_summary(rows, "ラップタイム")
    times = F.try_element_at(mine, F.lit(2))["cells"]
    return F.array_join(F.transform(data_cells(times), lambda c: c["text"]), "-")


def result_rows(pages: DataFrame, older: bool = False) -> DataFrame:
    """One row per finisher of the result pages (race_id, html)."""
    p = F.col("p")
    info = contest_columns(p) | (more_contest_columns(p) if older else {})
    table = first_table(p["rows"], "race_table_01")
    # The first row is the header; the field size counts every other row.
    rows = parsed_pages(pages).select(
        "race_id", *[c.alias(n) for n, c in info.items()],
        corner_map(p["rows"]).alias("corners"), lap_text(p["rows"]).alias("race_laps"),
        F.size(table).alias("_size"), F.explode(F.slice(table, F.lit(2), F.size(table))).alias("_r"))
    cells = data_cells(F.col("_r.cells"))
    rows = rows.withColumn("_c", cells).where(
        (F.size("_c") >= (19 if older else 20)) & at(F.col("_c"), 0)["text"].rlike(r"^\d+$"))
    c = F.col("_c")

    def text(i):
        return at(c, i)["text"]

    def linked(i, pattern):
        return found(at(c, i)["href"], pattern)

    gender, age = sex_age(text(4))
    weight, change = S.body_weight(text(14))
    fields = {
        "rank": text(0).try_cast("int"),
        "bracket": text(1).try_cast("int"), "horse_num": text(2).try_cast("int"),
        "horse_name": text(3), "horse_id": linked(3, r"/horse/(\d+)/"),
        "gender": gender, "age": age,
        "jockey": text(6), "jockey_id": linked(6, r"/jockey/.+/(\d+)/"),
        "trainer": text(18), "trainer_id": linked(18, r"/trainer/.+/(\d+)/"),
        "owner": text(19), "horse_weight": weight, "weight_change": change,
        "time": text(7), "passing_order": text(10),
        "agari_3f": plain_number(text(11)), "odds": plain_number(text(12)),
        "popularity": digits(text(13)),
        "prize": F.coalesce(F.regexp_replace(text(20), ",", "").try_cast("double"),
                            F.lit(0.0)),
    }
    if older:
        fields |= {"impost": plain_number(text(5)), "margin": text(8),
                   "n_horses": F.col("_size") - 1}
    # Rows whose numbers cannot be read are dropped, as a whole.
    return rows.select("race_id", *[v.alias(n) for n, v in fields.items()], *info,
                       "corners", "race_laps").where(
        F.col("bracket").isNotNull() & F.col("horse_num").isNotNull())


def payout_rows(pages: DataFrame) -> DataFrame:
    """(race_id, ticket_type, horse_nums, payout): lines of the two cells, side by side."""
    # Rows are chosen inside the generator: a filter behind it would read every page twice.
    rows = parsed_pages(pages).select("race_id", F.explode(F.filter(
        "p.rows", lambda r: has_class(r["block"], "pay_block"))).alias("r"))
    cells = data_cells(F.col("r.cells"))
    head = F.try_element_at(F.filter("r.cells", lambda c: c["tag"] == "th"), F.lit(1))
    pairs = F.arrays_zip(at(cells, 0)["lines"].alias("nums"),
                         at(cells, 1)["lines"].alias("amounts"))
    lines = rows.where(head.isNotNull() & (F.size(cells) >= 2)).select(
        "race_id", head["text"].alias("ticket_type"), F.explode(pairs).alias("z"))
    amount = F.regexp_replace("z.amounts", ",", "").try_cast("int")
    return lines.select("race_id", "ticket_type", F.col("z.nums").alias("horse_nums"),
                        amount.alias("payout")).where(
        F.col("horse_nums").isNotNull() & F.col("payout").isNotNull())


# --- entrant pages ----------------------------------------------------------------

def profile_rows(pages: DataFrame) -> DataFrame:
    """Owner, breeder and production area of the profile pages (horse_id, html)."""
    rows = parsed_pages(pages, "horse_id")
    cells = F.flatten(F.transform("p.rows", lambda r: r["cells"]))

    def after(label):
        """The cell after the header cell with this label."""
        here = F.array_position(F.transform(cells, lambda c: F.when(
            (c["tag"] == "th"), c["text"])), label).cast("int")
        return F.when(here > 0, F.get(cells, here))

    owner, breeder, area = after("馬主"), after("生産者"), after("産地")
    return rows.select(
        "horse_id",
        owner["link"].alias("owner_name"), found(owner["href"], r"/owner/(\d+)/")
        .alias("owner_id"),
        breeder["link"].alias("breeder_name"), found(breeder["href"], r"/breeder/(\d+)/")
        .alias("breeder_id"),
        area["text"].alias("production_area"))


def pedigree_rows(pages: DataFrame) -> DataFrame:
    """Sire, dam and dam's sire: first row, and the row that opens the second half."""
    table = first_table(F.col("p.rows"), "blood_table")
    top = data_cells(F.get(table, F.lit(0))["cells"])
    half = data_cells(F.get(table, F.floor(F.size(table) / 2).cast("int"))["cells"])
    parts = {"sire": at(top, 0), "dam": at(half, 0), "bms": at(half, 1)}
    return parsed_pages(pages, "horse_id").select("horse_id", *[
        x for name, cell in parts.items() for x in (
            cell["link"].alias(f"{name}_name"),
            found(cell["href"], r"/horse/(\w+)/").alias(f"{name}_id"))])


def horse_rows(profiles: DataFrame, pedigrees: DataFrame) -> DataFrame:
    return profile_rows(profiles).join(pedigree_rows(pedigrees), "horse_id", "left")


# --- race cards -------------------------------------------------------------------

def card_columns(p: Column) -> dict[str, Column]:
    data, day = p["data01"], r"\d+年\d+月\d+日"
    return {
        "surface": found(data, r"(芝|ダ|障)(\d+)m"),
        "distance": found(data, r"(芝|ダ|障)(\d+)m", 2).try_cast("int"),
        "weather": found(data, r"天候:(\S+)"), "condition": found(data, r"馬場:(\S+)"),
        "date": F.coalesce(F.when(p["data02"].rlike(day), p["data02"]),
                           found(p["title"], r"(\d{4}年\d{1,2}月\d{1,2}日)")),
    }


def _by_class(cells: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(cells, lambda c: c["cls"].rlike(pattern)), F.lit(1))


def entry_rows(pages: DataFrame) -> DataFrame:
    """One row per entrant of the race cards (race_id, html).

    Pages without a card table are read as result-style tables.
    """
    p = F.col("p")
    info = card_columns(p)
    card = first_table(p["rows"], "Shutuba_Table")
    card_rows = F.filter(card, lambda r: has_class(r["row_class"], "HorseList"))
    new, old = (first_table(p["rows"], n) for n in ("RaceTable01", "race_table_01"))
    fallback = F.filter(F.when(F.size(new) > 0, new).otherwise(old),
                        lambda r: F.size(data_cells(r["cells"])) >= 10)
    rows = parsed_pages(pages).select(
        "race_id", *[c.alias(n) for n, c in info.items()], (F.size(card) > 0).alias("_card"),
        F.explode(F.when(F.size(card) > 0, card_rows).otherwise(fallback)).alias("_r"))
    rows = rows.withColumn("_c", data_cells(F.col("_r.cells")))
    c, is_card = F.col("_c"), F.col("_card")

    def text(i):
        return at(c, i)["text"]

    def pick(from_card, from_result):
        return F.when(is_card, from_card).otherwise(from_result)

    def named(cls, i, pattern):
        """(name, id): of the card cell's link, or of the result cell."""
        mine, plain = _by_class(c, rf"(^|\s){cls}($|\s)"), at(c, i)
        return (pick(mine["link"], F.coalesce(plain["link"], plain["text"])),
                pick(found(mine["href"], pattern), found(plain["href"], pattern)))

    horse, horse_id = named("HorseInfo", 3, r"/horse/(\d+)")
    jockey, jockey_id = named("Jockey", 6, r"/jockey/.*?(\d+)")
    trainer = _by_class(c, r"(^|\s)Trainer($|\s)")
    gender, age = sex_age(text(4))
    body = pick(text(8), text(14))
    price = _by_class(c, r"Txt_R\s+Popular")["text"].try_cast("double")
    fields = {
        "bracket": pick(digits(_by_class(c, "Waku")["text"]), text(1).try_cast("int")),
        "horse_num": pick(digits(_by_class(c, "Umaban|Num")["text"]),
                          text(2).try_cast("int")),
        "horse_name": horse, "horse_id": horse_id, "jockey": jockey, "jockey_id": jockey_id,
        "trainer": pick(trainer["link"], F.lit(None)),
        "trainer_id": pick(found(trainer["href"], r"/trainer/.*?(\d+)"), F.lit(None)),
        "gender": gender, "age": age, "weight": text(5).try_cast("double"),
        "horse_weight": found(body, r"(\d+)").try_cast("int"),
        "weight_change": found(body, r"\(([-+]?\d+)\)").try_cast("int"),
        "odds": pick(F.coalesce(price, F.lit(0.0)), text(11).try_cast("double")),
        "popularity": text(10).try_cast("int"),
    }
    return rows.select("race_id", *[v.alias(n) for n, v in fields.items()], *info)


# --- links ------------------------------------------------------------------------

def ids_in_pages(pages: DataFrame, pattern: str = r"/horse/(\d+)/", html: str = "html"
                 ) -> DataFrame:
    """Sorted distinct ids found anywhere in the pages; native, no parsing."""
    return pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
                        .alias("id")).distinct().orderBy("id")


def linked_ids(pages: DataFrame, pattern: str = r"/race/(\d+)/", html: str = "html"
               ) -> DataFrame:
    """Sorted distinct ids of the link targets of the pages."""
    targets = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))
    ids = pages.select(F.explode(targets).alias("href")).select(
        found(F.col("href"), pattern).alias("id"))
    return ids.where(F.col("id").isNotNull()).distinct().orderBy("id")
