"""Readers and writers of the typed tables."""

from __future__ import annotations

import csv
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import schemas
from formline.functions import scalars as S
from formline.operators.history import vendor_history

JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"
PAGES_PER_FILE = 10_000
WHOLE_FILES = 1 << 50  # no file is cut, and none shares a task


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """The declared columns the table has, in their declared types; bad values are NULL."""
    wanted = T._parse_datatype_string(ddl)
    present = set(df.columns)

    def cast(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            # Whole numbers with gaps are often written as 480.0.
            return F.coalesce(c.try_cast(f.dataType), c.try_cast("double").try_cast(f.dataType))
        return c.try_cast(f.dataType)

    return df.select(*[cast(f).alias(f.name) for f in wanted if f.name in present])


def _first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.slice(0, 1)
        return


def first_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(header, file): the raw first line of every file that has one, found in one job.

    A task reads one record of one file and stops, however long the file is.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    own = spark.newSession()  # these settings are for this one scan
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", WHOLE_FILES)
    lines = own.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("value").cast("binary").alias("header"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(_first_of_partition, "header binary, file string")


def _same_header(spark: SparkSession, path: str | Sequence[str]
                 ) -> Iterator[tuple[bytes, str | list[str], DataFrameReader]]:
    """Each header, its files, and a reader that still sees the folders' partition columns.

    If all files share a header, the driver holds that line alone; else the paths, as Spark's
    own file listing does.
    """
    first = first_lines(spark, path)
    headers = first.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()
    if not headers:
        raise ValueError(f"no data in {path}")
    plain = path if isinstance(path, str) else list(path)
    if len(headers) == 1 and isinstance(plain, str):
        yield bytes(headers[0]["header"]), plain, spark.read
        return
    files: dict[bytes, list[str]] = {bytes(r["header"]): [] for r in headers}
    for r in first.orderBy("file").toLocalIterator():
        files[bytes(r["header"])].append(unquote(r["file"]))
    for header, own in files.items():
        whole = isinstance(plain, str) and not set("*?[{") & set(plain)
        yield header, own, spark.read.option("basePath", plain) if whole else spark.read


def _stacked(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns by name; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_csv(spark: SparkSession, path: str | Sequence[str], ddl: str | None = None,
             columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """CSV files with a header each; ``path`` may hold globs.

    Columns are found by name, also if the files order them differently or lack some, and
    typed as declared; nothing is inferred, and only the selected columns are parsed.
    """
    tables = []
    for _, files, reader in _same_header(spark, path):
        df = reader.option("header", True).csv(files)
        tables.append(typed(df, ddl) if ddl else df)
    df = _stacked(tables)
    if ddl:  # in the declared order, whatever the first file's
        df = df.select(*[f"`{f.name}`" for f in T._parse_datatype_string(ddl)
                         if f.name in df.columns])
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows is not None else df


def _decoded(line: bytes | None) -> str | None:
    if line is None:
        return None
    try:
        return bytes(line).decode("cp932")
    except UnicodeDecodeError:
        return bytes(line).decode("shift_jis", errors="replace")


def _decode_batches(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in raw:
        yield batch.map(_decoded)


def legacy_text(raw: str | Column) -> Column:
    """Text of cp932 bytes; shift_jis where cp932 does not fit."""
    # Shipped by value, so executors need no installed copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return F.pandas_udf(_decode_batches, "string")(raw)


def read_legacy_csv(spark: SparkSession, path: str | Sequence[str],
                    ddl: str | None = None) -> DataFrame:
    """CSV files in the legacy Japanese encoding, with a header each; columns go by name.

    Where the session allows Java charsets the CSV reader decodes by itself.  Otherwise
    lines are read as bytes (no character of the encoding contains a line end, so large
    files still split into many tasks) and decoded in Arrow batches.
    """
    tables = []
    for header, files, reader in _same_header(spark, path):
        if spark.conf.get(JAVA_CHARSETS, "false") == "true":
            df = reader.option("header", True).option("encoding", "windows-31j").csv(files)
        else:
            head = _decoded(header)
            # The text reader hands on the bytes of a line unchanged.
            lines = reader.text(files).select(
                legacy_text(F.col("value").cast("binary")).alias("line"))
            fields = ", ".join(f"`{n}` string" for n in next(csv.reader([head])))
            df = lines.where(F.col("line") != F.lit(head)).select(
                F.from_csv("line", fields).alias("r")).select("r.*")
        tables.append(typed(df, ddl) if ddl else df)
    return _stacked(tables)


def vendor_table(raw: DataFrame) -> DataFrame:
    """Vendor race rows with date, place code, text id, numeric figures and style code."""
    figures = ["PCI", "RPCI", "PCI3", "上り3F順位", "Ave-3F", "-3F差", "増減",
               "通過順1角", "通過順2角", "通過順3角", "通過順4角"]
    new = {
        "date_jv": S.vendor_date("年", "月", "日"),
        "place_code_jv": S.course_code_of_name("場所"),
        "horse_id_jv": F.col("血統登録番号").cast("string"),
    }
    new |= {c: S.number(F.col(f"`{c}`")) for c in figures if c in raw.columns}
    if "脚質" in raw.columns:
        new["running_style_encoded"] = S.style_code("脚質")
    return raw.withColumns(new)


def vendor_features(vendor: DataFrame, **skew) -> DataFrame:
    """The vendor columns that may be joined: keys, previous-race figures, fixed traits."""
    wide = vendor_history(vendor, **skew)
    renames = {"父タイプ": "sire_type", "母父タイプ": "bms_type", "増減": "weight_change_jv"}
    wide = wide.withColumnsRenamed(renames)
    wanted = ["horse_id_jv", "date_jv", "place_code_jv", "レース番号",
              *[c for c in wide.columns if c.startswith("prev_")], *renames.values()]
    return wide.select(*schemas.existing(wide, wanted))


def read_pages(spark: SparkSession, path: str | Sequence[str],
               id_pattern: str = r"race_(\d+)\.html", key: str = "race_id",
               names: str | None = None) -> DataFrame:
    """(id from the file name, html) of saved pages; one row per file.

    ``path`` is a glob of files, or with ``names`` (a glob of file names) one or more folders:
    each folder is then listed once, where a glob looks every file up again.
    """
    reader = spark.read.format("binaryFile")
    if names is not None:
        reader = reader.option("pathGlobFilter", names).option("recursiveFileLookup", True)
    files = reader.load(path if isinstance(path, str) else list(path))
    found = F.nullif(F.regexp_extract("path", id_pattern, 1), F.lit(""))
    # Bytes that are no UTF-8 are replaced; the page is kept.
    return files.select(found.alias(key),
                        F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def _page_files(path: str, prefix: str, batches: Iterator[pa.RecordBatch]
                ) -> Iterator[pa.RecordBatch]:
    """Write each (id, bytes) as a file of its own; yields the folder when all are written."""
    # Hadoop writes file:/folder, unescaped.
    store, root = ((fs.LocalFileSystem(), "/" + path[5:].lstrip("/"))
                   if path.startswith("file:") else fs.FileSystem.from_uri(path))
    name, n = f"pages-{uuid.uuid4().hex}", 0  # an attempt that fails leaves a folder none reads
    for batch in batches:
        if n == 0 and batch.num_rows:
            store.create_dir(f"{root}/{name}")
        for key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            # The number keeps pages of one id apart.
            with store.open_output_stream(f"{root}/{name}/{n}-{prefix}_{key}.html") as out:
                out.write((content or b"") + b"\n")
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n])],
                                         names=["folder", "pages"])


def write_page_files(pages: DataFrame, path: str, key: str = "race_id",
                     content: str = "html", prefix: str = "race") -> list[str]:
    """One file per page, ``{number}-{prefix}_{id}.html``; the folders, one for each task.

    Every file ends with a line end more than its page: Spark's readers skip empty files.

    The tasks that hold the pages write them through Arrow's file systems (local and shared
    folders, HDFS, object stores).  The folders are those of the attempts that Spark accepted.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    whole = store.makeQualified(folder).toString()

    def run(batches):
        return _page_files(whole, prefix, batches)
    written = pages.select(F.col(key).cast("string"), F.col(content).cast("binary")).mapInArrow(
        run, "folder string, pages long")
    return [r["folder"] for r in written.collect()] or [path]


def write_page_archive(pages: DataFrame, path: str, key: str = "race_id",
                       content: str = "html", pages_per_file: int = PAGES_PER_FILE) -> None:
    """Many pages per file, one record each: the id and the bytes as they are.

    ``pages`` may come from ``read_pages`` or be any table with the two columns; files are
    written by the tasks that hold the pages, without a shuffle.
    """
    pages.select(F.col(key).cast("string").alias(key),
                 F.col(content).cast("binary").alias("content")).write.option(
        "maxRecordsPerFile", pages_per_file).parquet(path)


def read_page_archive(spark: SparkSession, path: str | Sequence[str],
                      key: str = "race_id") -> DataFrame:
    """(id, html) of archived pages, as ``read_pages`` gives them; a page without bytes is NULL."""
    paths = [path] if isinstance(path, str) else list(path)
    archived = spark.read.schema(f"`{key}` string, content binary").parquet(*paths)
    return archived.select(key, F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require_columns(spark.read.parquet(path), schemas.REQUIRED_PREDICTIONS)


def write_table(df: DataFrame, path: str, kind: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet or CSV sink, optionally partitioned (features by year, cards by date)."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_settings(spark: SparkSession, path: str, settings: dict | list) -> None:
    """Small JSON document (feature list, parameters, blend weights)."""
    text = json.dumps(settings, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_settings(spark: SparkSession, path: str) -> dict | list:
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])
