"""Queues as streams: files that are scored once, and progress lines that are thinned out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scored_queue(spark: SparkSession, queue: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "image_id", files_per_batch: int = 100) -> StreamingQuery:
    """Scores work items as files arrive and appends them; the checkpoint stands for the list of what is done.

    A batch writes to a folder of its own number and overwrites it when it is run again after a failure, so no item is scored twice.
    """
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(queue)

    def one(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(stream: DataFrame, key: list[str], at: str, within: str = "10 minutes") -> DataFrame:
    """One live row per key: later ones within the time are dropped."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def _emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, least_ms: int) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    out = []
    for rows in batches:
        for r in rows.sort_values("ts").itertuples(index=False):
            now = int(r.ts.timestamp() * 1000)
            if last is None or (int(r.percent), r.message) != tuple(last[:2]) or now - last[2] >= least_ms:
                out.append((key[0], r.ts, r.percent, r.message))
                last = (int(r.percent), r.message, now)
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["job_id", "ts", "percent", "message"])


def thinned(progress: DataFrame, least_ms: int = 200) -> DataFrame:
    """Progress (job_id, ts, percent, message) of which a job emits the first, those that differ from the one emitted last, and others after ``least_ms``."""
    return progress.groupBy("job_id").applyInPandasWithState(lambda k, b, s: _emit(k, b, s, least_ms), "job_id string, ts timestamp, percent int, message string", "percent int, message string, at long", "append", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame, at: str = "ts", size: str = "5 minutes", late: str = "10 minutes", *by: str) -> DataFrame:
    """Counts and means of a value in windows of event time, with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
