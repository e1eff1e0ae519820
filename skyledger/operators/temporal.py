"""Observations in time: usable rows, periods, before and after, change per location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric


def skip_reason(ready: Column, captured: Column) -> Column:
    """Why an image is no observation; null if it is one. A null readiness passes; readiness is tested first."""
    return F.when(~ready, "not_analysis_ready").when(captured.isNull(), "missing_capture_time")


def split(images: DataFrame, ready: str = "analysis_ready", captured: str = "captured_at") -> tuple[DataFrame, DataFrame]:
    """(observations, skipped with reason)."""
    marked = images.withColumn("reason", skip_reason(F.col(ready), F.col(captured)))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def periods(obs: DataFrame, id_col: str = "id", captured: str = "captured_at") -> DataFrame:
    """(acquisition_date, images): the ids of a day in order of time, then id."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(captured).alias("t"), F.col(id_col).alias("id"))))
    return obs.groupBy(F.to_date(captured).alias("acquisition_date")).agg(F.transform(rows, lambda r: r["id"]).alias("images"))


def latest_two(obs: DataFrame, id_col: str = "id", captured: str = "captured_at", keys: list[str] | None = None) -> DataFrame:
    """The last image of each of the two last dates (by key), with date_rank 1 for the last.

    The dates are aggregated before they are ranked, so no window sees more rows than a key has dates.
    """
    keys = keys or []
    days = obs.withColumn("acquisition_date", F.to_date(captured)).groupBy(*keys, "acquisition_date").agg(F.max(F.struct(F.col(captured), F.col(id_col))).alias("_last"))
    days = days.filter("acquisition_date is not null")
    if keys:
        last = days.withColumn("date_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("acquisition_date")))).filter("date_rank <= 2")
    else:
        last = days.orderBy(F.desc("acquisition_date")).limit(2)
        last = last.withColumn("date_rank", F.row_number().over(Window.orderBy(F.desc("acquisition_date"))))
    return last.select(*keys, "acquisition_date", "date_rank", f"_last.{captured}", f"_last.{id_col}")


def intervals(obs: DataFrame, key: str, id_col: str = "id", captured: str = "captured_at") -> DataFrame:
    """Each observation with the one before it of its key, where that is strictly earlier; days between the dates."""
    w = Window.partitionBy(key).orderBy(captured, id_col)
    pairs = obs.select(key, F.col(id_col).alias("after_id"), F.lag(id_col).over(w).alias("before_id"), F.lag(captured).over(w).alias("before_at"), F.col(captured).alias("after_at"))
    return pairs.filter("after_at > before_at").withColumn("interval_days", F.datediff("after_at", "before_at").cast("long"))


def mismatched(before: DataFrame, after: DataFrame, key: str = "location_id") -> DataFrame:
    """(key, side) of locations that one side alone has."""
    one = before.join(after.select(key), key, "left_anti").select(key, F.lit("before").alias("side"))
    return one.unionByName(after.join(before.select(key), key, "left_anti").select(key, F.lit("after").alias("side")))


def _paired(before: DataFrame, after: DataFrame, key: str, value: str, how: str = "inner") -> DataFrame:
    return before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, how)


def class_changes(before: DataFrame, after: DataFrame, key: str = "location_id", value: str = "class_name") -> DataFrame:
    return _paired(before, after, key, value).withColumn("changed", F.col("before") != F.col("after"))


def count_changes(before: DataFrame, after: DataFrame, key: str = "location_id", value: str = "n") -> DataFrame:
    rows = _paired(before, after, key, value).withColumn("change", F.col("after").cast("long") - F.col("before").cast("long"))
    return rows.withColumn("direction", numeric.direction(F.col("change")))


def magnitudes(before: DataFrame, after: DataFrame, key: str = "location_id", value: str = "value", threshold: float = 10.0) -> DataFrame:
    """Change and magnitude rounded to 2 digits (half even); the level is that of the raw magnitude, significance that of the rounded."""
    raw = F.col("after") - F.col("before")
    rows = _paired(before, after, key, value).withColumn("level", numeric.magnitude_level(F.abs(raw)))
    rows = rows.withColumn("change", numeric.half_even(raw)).withColumn("magnitude", numeric.half_even(F.abs(raw)))
    return rows.withColumn("significant", F.col("magnitude") >= threshold)


def outer_changes(before: DataFrame, after: DataFrame, key: str = "plot_id", value: str = "n") -> DataFrame:
    """Locations of either side; the change is null where one is missing."""
    return _paired(before, after, key, value, "full_outer").withColumn("change", F.col("after") - F.col("before"))


def session_range(sessions: DataFrame, images: DataFrame) -> DataFrame:
    """Sessions with the first and last capture time of their images, the time of creation where there are none."""
    span = images.groupBy("session_id").agg(F.min("captured_at").alias("_a"), F.max("captured_at").alias("_b"))
    rows = sessions.join(span, sessions["id"] == span["session_id"], "left").drop("session_id")
    return rows.withColumn("date_start", F.coalesce("_a", "created_at")).withColumn("date_end", F.coalesce("_b", "created_at")).drop("_a", "_b")


def coverage_change(before: Column, after: Column) -> Column:
    """Percentage points; an error unless both lie in 0 to 100."""
    return numeric.checked(after, numeric.valid_coverage(after), "coverage outside 0 to 100") - numeric.checked(before, numeric.valid_coverage(before), "coverage outside 0 to 100")


def class_change_text(place: Column, before: Column, after: Column) -> Column:
    """"place: before -> after", null where nothing changed."""
    return F.when(before != after, F.concat(place.cast("string"), F.lit(": "), before, F.lit(" -> "), after))


def count_change_text(place: Column, change: Column, direction: Column) -> Column:
    return F.format_string("%s: %+d pohon (%s)", place.cast("string"), change.cast("long"), direction)


def coverage_change_text(change: Column) -> Column:
    return F.concat(F.lit("Perubahan: "), change.cast("double").cast("string"), F.lit(" percentage points"))
