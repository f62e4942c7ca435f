"""Session helpers: the shared scratch folder and parked (written) tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_parked: list[str] = []  # folders this driver has written and not yet cleared


def scratch_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local master may fall back to a folder of its own.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="formline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession, label: str) -> str:
    """Name of a new folder in the scratch folder; ``discard`` or ``clear_parked`` deletes it."""
    folder = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _parked.append(folder)
    return folder


def park(df: DataFrame, label: str, partition_by: list[str] | None = None,
         compression: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Catalyst the true
    size of the table, so that it picks a broadcast or a shuffled join by that size.
    """
    spark = df.sparkSession
    folder = own_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> bool:
    """Delete one folder of ``own_folder`` that later steps have replaced."""
    if folder not in _parked:
        return False
    _parked.remove(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_parked(spark: SparkSession) -> int:
    """Delete the tables this driver has parked; to be called when no result needs them."""
    return sum(discard(spark, folder) for folder in list(_parked))
