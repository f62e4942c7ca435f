"""Readers and writers: tables written by Spark, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.history import KEY
from checks.registry import query
from checks.tables import R, V, results, vendor
from formline import schemas
from formline.session import scratch_folder
from formline.sources import tables

FIELDS = ("race_id", "horse_num", "horse_id", "rank", "odds", "date", "horse_weight")
DDL = ("race_id string, horse_num int, horse_id string, rank int, odds double, date string,"
       " horse_weight int")


def folder(spark, label):
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written_csv(spark, sf):
    path = folder(spark, "csv")
    tables.write_table(results(spark, sf, *FIELDS), path, "csv")
    return path


@query("csv_scan", f"WITH {R} SELECT {', '.join(FIELDS)} FROM r")
def csv_scan(spark, sf):
    """Declared types; ids keep their leading zeros."""
    return tables.read_csv(spark, written_csv(spark, sf), DDL)


@query("csv_scan_columns", f"WITH {R} SELECT race_id, odds FROM r")
def csv_scan_columns(spark, sf):
    return tables.read_csv(spark, f"{written_csv(spark, sf)}/*.csv", DDL, ["race_id", "odds"])


#: Rows of a range of the sorted table, one file each.
RANGE_ROWS = 100_000


# The first rows of the first of the sorted files are known rows.
@query("csv_scan_first_rows", f"""WITH {R} SELECT race_id, horse_num FROM r
 ORDER BY race_id, horse_num LIMIT 25""")
def csv_scan_first_rows(spark, sf):
    path = folder(spark, "csv")
    df = results(spark, sf, *FIELDS)
    ranges = 1 + df.count() // RANGE_ROWS
    tables.write_table(df.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY), path, "csv")
    return tables.read_csv(spark, f"{path}/part-00000*", DDL, KEY, rows=25)


# Files whose headers differ: other order, a column missing, a column more.
@query("csv_files_by_name", f"""WITH {R} SELECT race_id, horse_num, odds, horse_id FROM r
 UNION ALL SELECT race_id, horse_num, odds, CAST(NULL AS STRING) FROM r""")
def csv_files_by_name(spark, sf):
    one, two = folder(spark, "csv"), folder(spark, "csv")
    df = results(spark, sf, "race_id", "horse_num", "odds", "horse_id")
    tables.write_table(df.select("horse_id", "race_id", "odds", "horse_num"), one, "csv")
    tables.write_table(df.select("odds", F.lit("x").alias("note"), "horse_num", "race_id"), two,
                       "csv")
    return tables.read_csv(spark, [one, two], DDL,
                           ["race_id", "horse_num", "odds", "horse_id"])


@query("csv_union_of_files", f"""WITH {R} SELECT race_id, horse_num FROM r
 UNION ALL SELECT race_id, horse_num FROM r""")
def csv_union_of_files(spark, sf):
    paths = [written_csv(spark, sf), written_csv(spark, sf)]
    return tables.read_csv(spark, paths, DDL, KEY)


VENDOR = ("場所", "脚質", "血統登録番号", "レース番号", "PCI", "event_id")
VENDOR_DDL = ("`場所` string, `脚質` string, `血統登録番号` string, `レース番号` int, PCI double,"
              " event_id bigint")


@query("legacy_csv_scan", f"""WITH {V} SELECT 場所, 脚質, 血統登録番号, "レース番号",
 TRY_CAST(PCI AS DOUBLE) AS "PCI", event_id FROM v""")
def legacy_csv_scan(spark, sf):
    """Files in the legacy encoding, written as bytes line by line and read back."""
    import pandas as pd

    def encoded(batches):
        def coded(text):
            # The bytes ride in a text column as Latin-1, which keeps each of them.
            return text.encode("cp932").decode("latin-1")

        yield pd.DataFrame({"value": [coded(",".join(VENDOR))]})  # header of the file
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["line"].map(coded)})

    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
                              for c in VENDOR])
    path = folder(spark, "legacy")
    coded = vendor(spark, sf).select(line.alias("line")).mapInPandas(encoded, "value string")
    coded.select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(path)
    return tables.read_legacy_csv(spark, path, VENDOR_DDL)


@query("vendor_features", f"""WITH {V}, f AS (SELECT *, make_date(2000 + 年, 月, 日) AS d FROM v)
 SELECT "血統登録番号" AS horse_id_jv, d AS date_jv, count(*) AS rows,
 min("父タイプ") AS sire_type FROM f GROUP BY 1, 2""")
def vendor_features(spark, sf):
    wide = tables.vendor_features(tables.vendor_table(vendor(spark, sf)))
    return wide.groupBy("horse_id_jv", "date_jv").agg(
        F.count("*").alias("rows"), F.min("sire_type").alias("sire_type"))


@query("feature_cache", f"WITH {R} SELECT race_id, horse_num, period, odds FROM r"
                        " WHERE period = 2022")
def feature_cache(spark, sf):
    """Features partitioned by year; one year is read from its own folder only."""
    path = folder(spark, "features")
    tables.write_table(results(spark, sf, *KEY, "period", "odds"), path,
                       partition_by=["period"])
    return spark.read.parquet(path).where("period = 2022").select(*KEY, "period", "odds")


@query("predictions_sink", f"WITH {R} SELECT race_id, horse_num, pred_prob, odds, rank, date"
                           " FROM r")
def predictions_sink(spark, sf):
    path = folder(spark, "predictions")
    tables.write_table(results(spark, sf, *schemas.REQUIRED_PREDICTIONS), path)
    return tables.read_predictions(spark, path)


@query("card_sink", f"WITH {R} SELECT race_id, horse_num, CAST(date_dt AS DATE) AS day,"
                    " pred_prob FROM r", ["pred_prob"])
def card_sink(spark, sf):
    """Daily CSV tables, one folder per date."""
    path = folder(spark, "cards")
    df = results(spark, sf, *KEY, "date_dt", "pred_prob").withColumn(
        "day", F.col("date_dt").cast("date")).drop("date_dt")
    tables.write_table(df, path, "csv", partition_by=["day"])
    return tables.read_csv(spark, path, "race_id string, horse_num int, pred_prob double,"
                                        " day date")


@query("page_files", "SELECT CAST(page_id AS STRING) AS page_id, length(html) AS size,"
                     " md5(html) AS digest FROM pages")
def page_files(spark, sf):
    """One file per page, the id in its name, read back whole."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    folders = tables.write_page_files(pages, folder(spark, "pages"), "page_id", prefix="page")
    read = tables.read_pages(spark, folders, r"page_(\d+)\.html", "page_id", names="*.html")
    # The writer ends every file with a line end.
    page = F.expr("substring(html, 1, length(html) - 1)")
    return read.select("page_id", F.length(page).cast("bigint").alias("size"),
                       F.md5(page).alias("digest"))


@query("page_archive", "SELECT CAST(page_id AS STRING) AS page_id, length(html) AS size,"
                       " md5(html) AS digest FROM pages")
def page_archive(spark, sf):
    """Many pages per file, one record each."""
    path = folder(spark, "archive")
    tables.write_page_archive(spark.read.parquet(f"{sf}/pages.parquet"), path, "page_id")
    return tables.read_page_archive(spark, path, "page_id").select(
        "page_id", F.length("html").cast("bigint").alias("size"), F.md5("html").alias("digest"))


WANTED = ("odds", "not_there", "race_id", "horse_num")


@query("existing_columns", f"WITH {R} SELECT odds, race_id, horse_num FROM r")
def existing_columns(spark, sf):
    """Of the wanted columns those the table has, in the wanted order."""
    df = results(spark, sf)
    return df.select(*schemas.existing(df, WANTED))


@query("missing_columns", f"""WITH {R} SELECT c AS missing, year, rows FROM
 (SELECT substr(race_id, 1, 4) AS year, count(*) AS rows FROM r GROUP BY 1),
 (SELECT unnest(['pred_prob', 'rank']) AS c)""")
def missing_columns(spark, sf):
    """Rows a year of a predictions table that lacks two required columns, per column."""
    df = results(spark, sf, *[c for c in schemas.REQUIRED_PREDICTIONS
                              if c not in ("rank", "pred_prob")])
    lacking = schemas.missing_columns(df, schemas.REQUIRED_PREDICTIONS)
    years = df.groupBy(F.substring("race_id", 1, 4).alias("year")).agg(F.count("*").alias("rows"))
    return years.select(F.explode(F.array(*map(F.lit, lacking))).alias("missing"), "year", "rows")
