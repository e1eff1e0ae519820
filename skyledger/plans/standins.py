"""The test tables read as catalogue frames: orders are images, customers sessions, nations projects, events plugin results, line items pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("captured_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("analysis_ready"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 160) - 80.0).alias("latitude"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 340) - 170.0).alias("longitude"),
    )


IMAGES = """images AS (SELECT o_orderkey AS id, o_custkey AS session_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS captured_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS analysis_ready, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 160 - 80.0::DOUBLE END AS latitude,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 340 - 170.0::DOUBLE END AS longitude FROM orders)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("project_id"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("plugin_id"), F.col("ts").alias("created_at"), "value", F.col("props").alias("metrics"))


def year_values(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """(location_id, value, n, class_name) of a year: whole-number sums, so that no order of addition shows."""
    rows = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == year)
    per = rows.groupBy(F.col("l_partkey").alias("location_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("_q"), F.count("*").alias("n"), F.max("l_returnflag").alias("class_name"))
    return per.select("location_id", (F.col("_q") / 8.0).alias("value"), "n", "class_name")


def year_sql(year: int, name: str) -> str:
    return f"{name} AS (SELECT l_partkey AS location_id, sum(l_quantity::BIGINT) / 8.0::DOUBLE AS value, count(*) AS n, max(l_returnflag) AS class_name FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY l_partkey)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, r, g, b): 20 images of 64 by 48, bands from 0 to 255."""
    k = F.col
    return table(spark, sf_dir, "lineitem").select(
        (k("l_suppkey") % 20).cast("int").alias("img"), ((k("l_partkey") * 7 + k("l_linenumber")) % 64).cast("int").alias("x"), (k("l_orderkey") % 48).cast("int").alias("y"),
        ((k("l_partkey") * 31 + k("l_linenumber") * 17) % 256).cast("int").alias("r"), ((k("l_orderkey") * 13 + k("l_suppkey") * 7) % 256).cast("int").alias("g"), ((k("l_partkey") + k("l_orderkey")) % 256).cast("int").alias("b"),
    )


PIXELS = """px AS (SELECT (l_suppkey % 20)::INT AS img, ((l_partkey * 7 + l_linenumber) % 64)::INT AS x, (l_orderkey % 48)::INT AS y,
    ((l_partkey * 31 + l_linenumber * 17) % 256)::INT AS r, ((l_orderkey * 13 + l_suppkey * 7) % 256)::INT AS g, ((l_partkey + l_orderkey) % 256)::INT AS b FROM lineitem)"""


def grid(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """(img, x, y, mask): one cell each, of the pixels of odd or even orders."""
    k = F.col
    rows = table(spark, sf_dir, "lineitem").filter((k("l_orderkey") % 2 == int(odd)))
    cells = rows.select((k("l_suppkey") % 20).cast("int").alias("img"), (k("l_partkey") % 64).cast("int").alias("x"), (k("l_orderkey") % 48).cast("int").alias("y"), k("l_quantity"))
    return cells.groupBy("img", "x", "y").agg((F.max("l_quantity") > 25).alias("mask"))


def grid_sql(odd: bool, name: str) -> str:
    return f"{name} AS (SELECT (l_suppkey % 20)::INT AS img, (l_partkey % 64)::INT AS x, (l_orderkey % 48)::INT AS y, max(l_quantity) > 25 AS mask FROM lineitem WHERE l_orderkey % 2 = {int(odd)} GROUP BY 1, 2, 3)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("point_id"), ((k * 37 % 3600) / 100.0 + 0.003).alias("lon"), ((k * 53 % 1800) / 100.0 - 9.0 + 0.003).alias("lat"))


POINTS = "pts AS (SELECT o_orderkey AS point_id, (o_orderkey * 37 % 3600) / 100.0::DOUBLE + 0.003 AS lon, (o_orderkey * 53 % 1800) / 100.0::DOUBLE - 9.0 + 0.003 AS lat FROM orders)"


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals, one for each supplier."""
    k = F.col("s_suppkey")
    lon, lat = (k * 7 % 30).cast("double"), (k * 5 % 15).cast("double") - 8
    p = lambda dx, dy: F.array(lon + dx, lat + dy)
    return table(spark, sf_dir, "supplier").select(k.alias("plot_id"), F.array(F.array(p(0.0, 0.0), p(2.0, 0.25), p(2.5, 2.0), p(0.5, 1.5), p(0.0, 0.0))).alias("rings"))
