"""A corpus through five stages; each reads what the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, secrets are masked, and what is left is encoded to piece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import neardup, phrases, pieces, secrets, toxicity
from formline.llm.registry import table
from formline.session import park, scratch_folder

MASK = "[secret]"


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``ids`` (column id); as many ids as there are, none is
    broadcast.  Rows without doc_id stay."""
    return docs.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id",
                     "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not call toxic."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model).where(F.col("predicted") == 0).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate class."""
    found = neardup.classes(docs)
    return without(docs, park(found.where(F.col("id") != F.col("class_id")).select("id"),
                              "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = phrases.hits(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, park(found.where(F.col("n_hit") > 0).select(F.col("doc").alias("id")),
                              "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask and n_chars counted anew where there was one."""
    found = secrets.with_secrets(docs, secrets.fitted(docs))
    masked = secrets.redacted(found, mask=MASK)
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(
        F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, and whether decoding them gives the text."""
    both = pieces.encoded_and_decoded(docs.select("doc_id", "text"))
    expected = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"),
                       (F.col("back") == expected).alias("same_text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]
#: Learned scores, signatures and automata: SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage is written as Parquet and read back."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
