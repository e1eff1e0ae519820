"""Dashboard, catalogue lookups, results and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import catalog, slices
from . import standins as s
from .registry import query


@query("""SELECT event_type AS indicator, count(DISTINCT user_id) AS plots, round(avg(round(value * 16) / 16), 4) AS mean_value, min(value) AS min_value, max(value) AS max_value
    FROM events JOIN customer ON c_custkey = user_id WHERE value IS NOT NULL GROUP BY event_type""")
def indicator_aggregates(spark, sf_dir):
    rows = s.results(spark, sf_dir).join(s.sessions(spark, sf_dir).select(F.col("id").alias("session_id")), "session_id").select("session_id", F.col("plugin_id").alias("indicator"), "value", (F.round(F.col("value") * 16) / 16).alias("_v"))
    out = catalog.indicator_aggregates(rows, "session_id", ("indicator",)).drop("mean_value")
    mean = catalog.indicator_aggregates(rows.withColumn("value", F.col("_v")), "session_id", ("indicator",)).select("indicator", F.round("mean_value", 4).alias("mean_value"))
    return out.join(mean, "indicator")


@query("SELECT event_type AS plugin_id, count(*) AS runs, max(ts) AS last_run FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY event_type")
def plugin_usage(spark, sf_dir):
    projects = s.table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("project_id"))
    sessions = s.sessions(spark, sf_dir).join(projects, "project_id").select(F.col("id").alias("session_id"))
    return catalog.usage(s.results(spark, sf_dir).join(sessions, "session_id"))


@query(f"""WITH {s.IMAGES} SELECT (SELECT count(*) FROM customer) AS sessions, (SELECT count(*) FROM images JOIN customer ON c_custkey = session_id) AS images,
    (SELECT count(*) FROM images JOIN customer ON c_custkey = session_id WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS geotagged, (SELECT coalesce(sum(p_size), 0) / 10000.0::DOUBLE FROM part) AS area_ha""")
def dashboard_totals(spark, sf_dir):
    sessions = s.sessions(spark, sf_dir)
    images = s.images(spark, sf_dir).join(sessions.select(F.col("id").alias("session_id")), "session_id")
    return catalog.dashboard(
        sessions=sessions.agg(F.count("*").alias("sessions")),
        images=images.agg(F.count("*").alias("images"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geotagged")),
        plots=s.table(spark, sf_dir, "part").agg((F.coalesce(F.sum("p_size"), F.lit(0)) / 10000.0).alias("area_ha")),
    )


@query(f"WITH {s.IMAGES} SELECT c_nationkey AS project_id, count(*) AS images, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS geotagged FROM images JOIN customer ON c_custkey = session_id GROUP BY 1")
def geotagged_count(spark, sf_dir):
    rows = s.images(spark, sf_dir).join(s.sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "project_id"), "session_id")
    return rows.groupBy("project_id").agg(F.count("*").alias("images"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geotagged"))


@query("""WITH top AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
    SELECT event_id AS id, event_type AS plugin_id, ts AS created_at, k AS key, CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (props ->> ('$.' || k))::DOUBLE END AS value FROM (SELECT *, unnest(json_keys(props)) AS k FROM top)""")
def result_explorer(spark, sf_dir):
    """The latest 500 runs (the report's limit), then their metrics."""
    top = s.results(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(500)
    return metrics.flattened(top.select("id", "plugin_id", "created_at", "metrics"), "metrics").select("id", "plugin_id", "created_at", "key", "value")


@query(f"WITH {s.IMAGES}, q AS (SELECT id, session_id FROM images WHERE analysis_ready IS DISTINCT FROM true) SELECT DISTINCT q.session_id FROM q SEMI JOIN customer ON c_custkey = q.session_id AND c_acctbal > 0")
def pending_sessions(spark, sf_dir):
    queue = s.images(spark, sf_dir).filter("analysis_ready is distinct from true").select("session_id")
    alive = s.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"))
    return queue.join(alive, "session_id", "left_semi").distinct()


@query(f"""WITH {s.IMAGES} SELECT c_custkey AS id, (SELECT count(*) FROM images WHERE session_id = c_custkey) AS images, (SELECT count(*) FROM images WHERE session_id = c_custkey AND latitude IS NOT NULL AND longitude IS NOT NULL) AS geotagged FROM customer""")
def project_rollup_counts(spark, sf_dir):
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return catalog.counts_per_parent(s.sessions(spark, sf_dir).select("id"), s.images(spark, sf_dir), "id", "session_id", images=F.lit(True), geotagged=located)


@query("SELECT user_id AS session_id, event_type AS plugin_id, max_by(event_id, (ts, event_id)) AS id, max(ts) AS created_at FROM events GROUP BY 1, 2")
def upsert_latest(spark, sf_dir):
    rows = s.results(spark, sf_dir).select("session_id", "plugin_id", "created_at", "id")
    return catalog.upsert(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["session_id", "plugin_id"], "created_at", "id").select("session_id", "plugin_id", "id", "created_at")


@query("""SELECT session_id, event_type AS key, value FROM (SELECT user_id AS session_id, *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('purchase', 'view') AND value IS NOT NULL) WHERE k = 1""")
def latest_metric(spark, sf_dir):
    rows = s.results(spark, sf_dir).withColumnRenamed("plugin_id", "key")
    return catalog.latest_metric(rows, ["purchase", "view"], image="session_id")


@query("""WITH m AS (SELECT user_id AS g, event_id % 4 AS s, event_type AS k, sum(round(value * 16)) / 16 AS v FROM events GROUP BY 1, 2, 3), n AS (SELECT g, s, CASE k WHEN 'click' THEN 'sampled_pixels' WHEN 'view' THEN 'tree_count' WHEN 'purchase' THEN 'mean_index' ELSE k || '_ratio' END AS key, v FROM m),
    w AS (SELECT g, s, greatest(coalesce(max(v) FILTER (key = 'sampled_pixels'), 1), 1) AS w FROM n GROUP BY 1, 2), c AS (SELECT g, count(*) AS slices FROM w GROUP BY g)
    SELECT g AS grp, key, CASE WHEN slices = 1 THEN sum(v) WHEN key IN ('sampled_pixels', 'tree_count') THEN sign(sum(v)) * floor(abs(sum(v)) + 0.5)
        WHEN count(*) = slices THEN sign(sum(v * w) / sum(w)) * floor(abs(sum(v * w) / sum(w)) * 10000 + 0.5) / 10000 ELSE sign(sum(v) / count(*)) * floor(abs(sum(v) / count(*)) * 10000 + 0.5) / 10000 END AS value FROM n JOIN w USING (g, s) JOIN c USING (g) GROUP BY g, key, slices""")
def slice_merge(spark, sf_dir):
    key = F.when(F.col("plugin_id") == "click", "sampled_pixels").when(F.col("plugin_id") == "view", "tree_count").when(F.col("plugin_id") == "purchase", "mean_index").otherwise(F.concat("plugin_id", F.lit("_ratio")))
    rows = s.results(spark, sf_dir).groupBy(F.col("session_id").alias("grp"), (F.col("id") % 4).alias("slice"), key.alias("key")).agg((F.sum(F.round(F.col("value") * 16)) / 16).alias("value")).withColumn("text_value", F.lit(None).cast("string"))
    return slices.merged(rows, "grp", "slice").select("grp", "key", "value")


@query("""WITH v AS (SELECT user_id AS plot_id, max(round(value * 16) / 16) AS value FROM events GROUP BY 1) SELECT plot_id, value, row_number() OVER (ORDER BY value DESC, plot_id) AS rank, round((SELECT avg(value) FROM v), 4) AS mean_value FROM v""")
def plot_ranking(spark, sf_dir):
    rows = s.results(spark, sf_dir).groupBy(F.col("session_id").alias("plot_id")).agg(F.max(F.round(F.col("value") * 16) / 16).alias("value"))
    return catalog.ranking(rows, "value", "plot_id").withColumn("mean_value", F.round("mean_value", 4)).select("plot_id", "value", F.col("rank").cast("long").alias("rank"), "mean_value")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7 UNION SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def union_lookup(spark, sf_dir):
    rows = s.sessions(spark, sf_dir).select("id", "name")
    return rows.filter("id = 7").union(rows.filter("name = 'Customer#000000007'")).distinct()


@query("""SELECT event_id::VARCHAR AS detection_id, value FROM events WHERE event_id % 3 <> 0 AND NOT (event_id % 3 = 1 AND event_type = 'error') UNION ALL SELECT 'manual-' || event_id, value FROM events WHERE event_id % 3 = 0""")
def review_apply(spark, sf_dir):
    rows = s.results(spark, sf_dir).select(F.col("id").cast("string").alias("detection_id"), "value", "id", "plugin_id")
    keep = ["detection_id", "value"]
    return catalog.review(rows.filter("id % 3 <> 0").select(keep), rows.filter("id % 3 = 1 and plugin_id = 'error'"), rows.filter("id % 3 = 0").select(keep))


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page_sessions(spark, sf_dir):
    return catalog.page(s.sessions(spark, sf_dir).select("id", "name"), 3, 20, "name", "id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE lower(c_name) LIKE '%00001%' AND c_mktsegment = 'BUILDING'")
def session_filter(spark, sf_dir):
    rows = s.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return rows.filter(F.lower("c_name").contains("00001")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT o_orderkey AS id FROM orders ANTI JOIN customer ON c_custkey = o_custkey AND c_nationkey = 3")
def project_cascade_delete(spark, sf_dir):
    gone = s.sessions(spark, sf_dir).filter("project_id = 3")
    return catalog.without(s.images(spark, sf_dir), gone.select(F.col("id").alias("session_id")), "session_id").select("id")


@query("SELECT event_type AS indicator, count(*) AS n, round(avg(round(value * 16) / 16), 4) AS mean_value, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(round(value * 16) / 16), 3) AS std_value FROM events WHERE value IS NOT NULL GROUP BY 1")
def plot_statistics(spark, sf_dir):
    v = F.round(F.col("value") * 16) / 16
    return s.results(spark, sf_dir).filter("value is not null").groupBy(F.col("plugin_id").alias("indicator")).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.stddev_samp(v), 3).alias("std_value"))
