"""Table sources, and views for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset, in local mode.
OWN_SHARED_DIR = "file:///tmp/foliant-shared"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the tables that it names. Views are bound when the query is analysed."""
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. There is a default in local mode alone: elsewhere a machine's own folder would lose data."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = OWN_SHARED_DIR
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(frame: DataFrame, root: str) -> DataFrame:
    """What a scratch folder holds, as a checkpoint in the shared folder; the scratch folder goes."""
    shared_dir(frame.sparkSession)
    out = frame.checkpoint()
    remove(frame.sparkSession, root)
    return out
