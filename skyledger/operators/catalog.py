"""Catalogue tables: scope, lookups, last write wins, cascades, dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_project(project: str, col: str = "project_id", or_null: bool = True) -> Column:
    """Rows of a project; those of no project too, unless strict."""
    own = F.col(col) == project
    return own | F.col(col).isNull() if or_null else own


def latest_by_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last by ``order``. An aggregate of whole rows: it combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*(c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return latest_by_key(table.unionByName(changes, allowMissingColumns=True), keys, *order)


def without(table: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """``table`` less the rows whose key ``gone`` has."""
    keys = gone.select(F.col(gone_key or key).alias("_gone")).distinct()
    return table.join(keys, table[key] == keys["_gone"], "left_anti")


def renamed(table: DataFrame, row_id, name: str, id_col: str = "id", name_col: str = "name", most: int = 100) -> DataFrame:
    """``table`` with one row renamed; the name is trimmed and must have 1 to ``most`` characters."""
    if not 1 <= len(name.strip()) <= most:
        raise ValueError("name must have 1 to 100 characters")
    return table.withColumn(name_col, F.when(F.col(id_col) == row_id, name.strip()).otherwise(F.col(name_col)))


def updated(table: DataFrame, key: str, value, **changes) -> DataFrame:
    """``table`` with columns of one row set."""
    for col, new in changes.items():
        table = table.withColumn(col, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(col)))
    return table


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page, counted from 1; a number below counts as the first."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def indicator_aggregates(indicators: DataFrame, plot_key: str = "plot_id", by: tuple[str, ...] = ("indicator", "unit")) -> DataFrame:
    """Per indicator and unit (a null unit is one): plots, mean, least and largest of the numeric values."""
    rows = indicators.filter("value is not null")
    return rows.groupBy(*by).agg(F.countDistinct(plot_key).alias("plots"), F.avg("value").alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def usage(results: DataFrame, by: str = "plugin_id", at: str = "created_at") -> DataFrame:
    return results.groupBy(by).agg(F.count("*").alias("runs"), F.max(at).alias("last_run"))


def dashboard(**frames: DataFrame) -> DataFrame:
    """One row from frames of one row each."""
    out = None
    for f in frames.values():
        out = f if out is None else out.crossJoin(f)
    return out


def counts_per_parent(parents: DataFrame, children: DataFrame, key: str, child_key: str, **counts: Column) -> DataFrame:
    """Parents with counts over their children, zero where there are none."""
    agg = children.groupBy(F.col(child_key).alias("_k")).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    joined = parents.join(agg, parents[key] == agg["_k"], "left").drop("_k")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in counts})


def latest_metric(results: DataFrame, keys: list[str], image: str = "image_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Per image the value of the first of ``keys`` that any result has, from the newest such result."""
    rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    found = results.withColumn("_rank", rank).filter("_rank > 0 and value is not null")
    return found.groupBy(image).agg(F.max_by(F.struct("key", "value"), F.struct(-F.col("_rank"), F.col(at), F.col(tie))).alias("_m")).select(image, "_m.key", "_m.value")


def review(detections: DataFrame, removed: DataFrame, added: DataFrame, id_col: str = "detection_id") -> DataFrame:
    """Detections less the removed ones, with manual ones."""
    from ..functions.text import manual_id

    return detections.join(removed.select(id_col).distinct(), id_col, "left_anti").unionByName(added.withColumn(id_col, manual_id(F.col(id_col))))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with rank, its place from 1 in that order.

    Ranges are sorted in parallel; only their sizes meet in one task. rank = rows in earlier ranges + place in its own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    local = part.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_p").withColumn("rank", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def ranking(df: DataFrame, value: str, *tie: str) -> DataFrame:
    """Rows with mean_value over all and their rank by value, descending."""
    return numbered(df, F.desc(value), *tie).crossJoin(df.agg(F.avg(value).alias("mean_value")))
