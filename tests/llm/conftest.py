import os
from pathlib import Path

import pytest
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
# Python workers import the package by the same path.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns."""
    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None,
                 None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df
    return make
