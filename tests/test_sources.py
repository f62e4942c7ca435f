"""Pages, files and the scratch folder."""

import pytest
from pyspark.sql import functions as F

from formline import session
from formline.sources import html, tables

RESULT = """<div class="data_intro"><p class="smalltxt">2023年1月5日 1回中山1日目 (芝右1600)</p>
<dl class="racedata fc"><dt>天候 :</dt><dd>晴</dd></dl></div>
<table class="race_table_01 nk_tb"><tr><th>着順</th></tr>{rows}</table>"""


def row(first, weight="480(+2)", cells=21):
    middle = [first, "1", "2", '<a href="/horse/2015104961/">Name</a>', "牡3", "55.0",
              '<a href="/jockey/result/recent/01088/">J</a>', "1:35.5", "1/2", "", "10-10-9",
              "35.1", "2.5", "1", weight, "", "", "", '<a href="/trainer/x/00123/">T</a>', "O",
              "1,100.0"]
    return "<tr>" + "".join(f"<td>{c}</td>" for c in middle[:cells]) + "</tr>"


def results(spark, page, **options):
    df = spark.createDataFrame([("202306010101", page)], "race_id string, html string")
    return html.result_rows(df, **options).collect()


def test_result_page(spark):
    page = RESULT.format(rows=row("1") + row("取") + row("2", "計不") + row("3", cells=18))
    one, two = results(spark, page)
    assert (one["rank"], one["horse_id"], one["jockey_id"], one["trainer_id"]) == (
        1, "2015104961", "01088", "00123")
    assert (one["gender"], one["age"], one["horse_weight"], one["weight_change"]) == (
        "牡", 3, 480, 2)
    assert (one["prize"], one["surface"], one["distance"], one["date"]) == (
        1100.0, "芝", 1600, "2023年1月5日")
    assert (two["rank"], two["horse_weight"], two["weight_change"]) == (2, None, None)


def test_older_fields(spark):
    page = "<h1>特別</h1>" + RESULT.format(rows=row("1") + row("取"))
    one, = results(spark, page, older=True)
    assert (one["around"], one["race_class"], one["place"], one["n_horses"], one["margin"],
            one["impost"]) == ("右", "特別", "Nakayama", 2, "1/2", 55.0)


@pytest.mark.parametrize("page", ["", "<table", "no table", "<td>1</td>", None, "<a href='x'"])
def test_pages_without_rows(spark, page):
    assert results(spark, page) == []


def test_bad_page_is_reported_not_raised(monkeypatch):
    def broken(self, text):
        raise RuntimeError("unreadable")
    monkeypatch.setattr(html._PageReader, "feed", broken)
    page = html.read_page("<a>")
    assert "unreadable" in page["error"] and page["rows"] == []


def test_open_cells_are_closed(spark):
    parts = html.read_page("<table><tr><td>1<td>2<tr><td>3</table><p>x")
    assert [[c["text"] for c in r["cells"]] for r in parts["rows"]] == [["1", "2"], ["3"]]


def test_payout_lines(spark):
    page = ('<dl class="pay_block"><table><tr><th>複勝</th><td>1<br/>2<br/>3</td>'
            '<td>110<br/>x<br/>1,340</td></tr><tr><th>空</th></tr></table></dl>')
    df = spark.createDataFrame([("r", page)], "race_id string, html string")
    got = [tuple(r) for r in html.payout_rows(df).collect()]
    assert got == [("r", "複勝", "1", 110), ("r", "複勝", "3", 1340)]


def test_legacy_files(spark, tmp_path):
    text = "場所,PCI,名前\n東京,45.5,ﾏｸﾘ\n中山,---,\"髙橋,はしご\"\n"
    (tmp_path / "a.csv").write_bytes(text.encode("cp932"))
    (tmp_path / "b.csv").write_bytes(text.replace("45.5", "50").encode("cp932"))
    df = tables.read_legacy_csv(spark, f"{tmp_path}/*.csv", "`場所` string, PCI double, `名前` string")
    got = sorted(tuple(r) for r in df.select("場所", "名前").collect())
    assert got == [("中山", "髙橋,はしご")] * 2 + [("東京", "ﾏｸﾘ")] * 2
    assert sorted(r[0] for r in df.where("PCI IS NOT NULL").select("PCI").collect()) == [45.5, 50]


def test_first_lines_of_many_files(spark, tmp_path):
    """One line a file, also of long files, odd names and both line ends; empty ones have none."""
    names = ["a b%20.csv", "c+d.csv", "long.csv", "名.csv"]
    for i, name in enumerate(names):
        (tmp_path / name).write_bytes(
            b"x,y\r\n1,2\r\n" if i % 2 else b"y,x\n" + b"2,1\n" * (50_000 if i == 2 else 1))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = [(bytes(r.header), r.file) for r in tables.first_lines(spark, str(tmp_path)).collect()]
    assert sorted(h for h, _ in got) == [b"x,y", b"x,y", b"y,x", b"y,x"]
    assert len({f for _, f in got}) == 4
    df = tables.read_csv(spark, str(tmp_path), "x int, y int")
    assert df.where("x = 1 AND y = 2").count() == df.count() == 50_003


def test_whole_numbers_written_with_a_point(spark, tmp_path):
    (tmp_path / "a.csv").write_text("race_id,rank,odds,extra\n0123,3.0,1.5,x\n0124,,---,y\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "race_id string, rank int, odds double")
    assert [tuple(r) for r in got.orderBy("race_id").collect()] == [
        ("0123", 3, 1.5), ("0124", None, None)]


def test_page_files_keep_bad_bytes(spark, tmp_path):
    (tmp_path / "race_202301.html").write_bytes(b"<p>\xff ok</p>")
    (tmp_path / "race_202302.html").write_text("<p>芝</p>")
    got = {r[0]: r[1] for r in tables.read_pages(spark, f"{tmp_path}/race_*.html").collect()}
    assert got["202302"] == "<p>芝</p>" and got["202301"].endswith(" ok</p>")


def test_page_files_one_for_each_row(spark, tmp_path):
    from checks import QUERIES
    pages = [("1", "<p>芝</p>"), ("2", ""), ("1", "<p>a</p>\n\r\n"), (None, "x"), ("3", "\n")]
    df = spark.createDataFrame(pages, "page_id string, html string").coalesce(1)
    shared = tmp_path / "a b"
    folders = tables.write_page_files(df.repartition(3), str(shared), "page_id", prefix="page")
    assert 1 <= len(folders) <= 3  # a folder for each task, not for each page
    assert len(list(shared.glob("*/*.html"))) == 5
    left = shared / "pages-left"  # what an attempt that failed has written is not read
    left.mkdir()
    (left / "0-page_9.html").write_text("half")
    got = tables.read_pages(spark, folders, r"page_(\d+)\.html", "page_id", names="*.html")
    got = got.withColumn("html", F.expr("left(html, length(html) - 1)"))  # the added line end
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    none = tables.write_page_files(df.where("page_id = 'x'"), str(tmp_path / "none"), "page_id")
    assert tables.read_pages(spark, none, names="*.html").count() == 0
    # Two rows of one id were written to one file.
    df.where("page_id IS NOT NULL").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["page_files"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.size) for r in rows) == [("1", 8), ("1", 11), ("2", 0), ("3", 1)]


def test_page_archive_gives_what_the_files_give(spark, tmp_path):
    (tmp_path / "race_202301.html").write_bytes(b"<p>\xff ok</p>")
    (tmp_path / "race_202302.html").write_text("")
    pages = spark.createDataFrame([("a", b"<p>\xff</p>", 1), (None, b"", 2), ("b", None, 3),
                                   ("a", b"<p>\xff</p>", 1)], "race_id string, html binary, x int")
    tables.write_page_archive(pages.coalesce(1), str(tmp_path / "one"), pages_per_file=3)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 2
    got = sorted(map(str, tables.read_page_archive(spark, str(tmp_path / "one")).collect()))
    assert len(got) == 4 and len(set(got)) == 3
    files = tables.read_pages(spark, f"{tmp_path}/race_*.html")
    tables.write_page_archive(files, str(tmp_path / "two"))
    back = tables.read_page_archive(spark, str(tmp_path / "two"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
    tables.write_page_archive(pages.where("x > 9"), str(tmp_path / "none"))
    assert tables.read_page_archive(spark, str(tmp_path / "none")).count() == 0


def test_settings(spark, tmp_path):
    tables.write_settings(spark, str(tmp_path / "s"), {"weight": 0.4, "名": ["a"]})
    assert tables.read_settings(spark, str(tmp_path / "s")) == {"weight": 0.4, "名": ["a"]}


def test_vendor_table(spark):
    raw = spark.createDataFrame(
        [(15, 3, 1, "東京", 11, "2012100001", "先行", "45.5", 2.0, "X"),
         (15, 4, 1, "小倉", 1, "2012100001", "?", "---", 1.0, "X")],
        "`年` int, `月` int, `日` int, `場所` string, `レース番号` int, `血統登録番号` string,"
        " `脚質` string, PCI string, `確定着順` double, `父タイプ` string")
    first, second = tables.vendor_features(tables.vendor_table(raw)).orderBy("date_jv").collect()
    assert first["prev_pci"] is None
    assert (second["prev_pci"], second["prev_running_style_jv"], second["prev_rank_jv"],
            second["place_code_jv"], second["sire_type"]) == (45.5, 2, 2.0, "10", "X")


def test_scratch_folder_is_the_one_named(spark):
    assert session.scratch_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.scratch_folder(spark) == named.rstrip("/")


def test_first_rows_are_read_from_the_whole_table(spark, monkeypatch):
    from checks import QUERIES, files
    from checks.tables import results as contests
    folder, written = "/root/testdata/sf0.001", []

    def spy(df, path, *args, write=tables.write_table):
        write(df, path, *args)
        written.append(spark.read.option("header", True).csv(path).count())
    monkeypatch.setattr(tables, "write_table", spy)
    monkeypatch.setattr(files, "RANGE_ROWS", 300, raising=False)
    rows = contests(spark, folder, *files.KEY)
    got = [tuple(r) for r in QUERIES["csv_scan_first_rows"](spark, folder).collect()]
    assert got == [tuple(r) for r in rows.orderBy(*files.KEY).limit(25).collect()]
    assert written == [rows.count()] and written[0] > 500


def test_references_may_stay_as_written():
    page = "<title> a &amp;&lt b&amp</title><table><tr><td><a href='?x&amp;y'>&gt;</a>"
    plain, written = html.read_page(page), html.read_page(page, references=False)
    assert plain["title"] == "a &< b&" and written["title"] == "a &amp;&lt b&amp"
    cell, = written["rows"][0]["cells"]
    assert (cell["text"], cell["href"]) == ("&gt;", "?x&amp;y")


ROWS = ("<dl class='a'><table class=\"t u\"><tr class=r><td>1<td> x &amp; y </td>\n<th nowrap>"
        "<a href=\"/q?a=1&amp;b=2\">L</a><br/>m</th></tr><tr><td><table><tr><td>in</td></table>z"
        "</td></tr></table></dl><h1> h <b>i</b></h1>")


def test_plain_pages_read_as_the_parser_reads_them(monkeypatch):
    pages = [ROWS, ROWS.replace("'a'", '"a"'), ROWS.replace("'a'", '"a"') + "<p>",
             '<title>t</title><style>td{}</style><table><tr><td class="A b">1</TD></table>',
             "<table><tr><td>1</td> <td><a>no</a><a href=\"u\"> two </a></td></tr></table>"]
    fast = [html.read_page(p) for p in pages]
    assert sum(html._PageReader()._feed_plain(p) for p in pages) == 4
    monkeypatch.setattr(html._PageReader, "_feed_plain", lambda self, data: False)
    assert fast == [html.read_page(p) for p in pages]


def test_pages_are_read_once(spark):
    df = spark.createDataFrame([("r", "<table>")], "race_id string, html string")
    for read in (html.payout_rows(df), html.page_errors(df)):
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_plain_cells_and_links_are_read_without_a_step_for_each(monkeypatch):
    """Cells and links of one kind are most of a page; they read as ``HTMLParser`` reads them."""
    import random
    from html.parser import HTMLParser

    from formline.sources import html
    parts = ["<td>a</td>", "<td> b &amp; c</td>\n", "<td>", "</td>", "<tr>", "</tr>", "<th>h</th>",
             '<a href="/x/1/">y</a>', '<a href="">e</a>', "<table>", "</table>", "<style>",
             "</style>", "<TD>d</TD>", "text", '<td class="k l">m</td>', "<br/>", "<a>n</a>"]
    choose = random.Random(3)
    pages = ["<table><tr>" + "".join(choose.choices(parts, k=20)) for _ in range(500)]

    class Plain(html._PageReader):
        def feed(self, data):
            HTMLParser.feed(self, data)
    found = [html.read_page(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html, "_PageReader", Plain)
        assert found == [html.read_page(p) for p in pages]
    monkeypatch.setattr(html._PageReader, "_whole", None)
    page = html.read_page('<table><tr><td>a</td><td><a href="/x/1/">y</a></td></tr></table>')
    assert page["error"] is None and page["rows"][0]["cells"][1]["link"] == "y"
