"""Helpers shared by the text operators: scratch tables, Arrow mapping, text columns."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and Spark runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skyledger-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a scratch table and read again: it is computed once, and lineage ends at the files."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    schema = df.schema
    del df
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def small_or_not(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``table``, a saved one of a few numbers a row, to be broadcast if it is counted to have at most ``rows`` rows; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= rows else table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``saved`` made, once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def release(spark: SparkSession, wait: float = 0) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more; its cleaner gets ``wait`` seconds for large ones."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(wait)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sql_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from record batches to dicts of columns. ``schema`` reads "name type, name type"."""
    out = sql_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def by_text(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[tuple[list, list]]:
    """Slices of (ids, texts) of at most ``step`` rows."""
    for b in batches:
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_path(module: str, name: str) -> str:
    """Where the public tokenizer files lie on the machine that asks."""
    return os.fspath(__import__(module).path(name))
