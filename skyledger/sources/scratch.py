"""The folder all executors share, and files in it through whatever store it is in."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skyledger-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a fresh table and read again: it is computed once, and its lineage ends at the files."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; Hadoop writes local paths as file:/a, and a plain path is local too."""
    if uri.startswith("/"):
        uri = "file://" + uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)
