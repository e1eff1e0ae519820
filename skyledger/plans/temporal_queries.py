"""Observations, periods, change over time, blur, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import blur, imports, temporal
from . import standins as s
from .registry import query

_BA = f"WITH {s.year_sql(1995, 'b')}, {s.year_sql(1996, 'a')}"


def _years(spark, sf_dir):
    return s.year_values(spark, sf_dir, 1995), s.year_values(spark, sf_dir, 1996)


@query(f"WITH {s.IMAGES} SELECT id, CASE WHEN NOT analysis_ready THEN 'not_analysis_ready' WHEN captured_at IS NULL THEN 'missing_capture_time' ELSE 'observation' END AS reason FROM images")
def observation_split(spark, sf_dir):
    good, skipped = temporal.split(s.images(spark, sf_dir))
    return good.select("id", F.lit("observation").alias("reason")).unionByName(skipped.select("id", "reason"))


@query(f"WITH {s.IMAGES} SELECT captured_at::DATE AS acquisition_date, string_agg(id::VARCHAR, ',' ORDER BY captured_at, id) AS images FROM images WHERE captured_at IS NOT NULL GROUP BY 1")
def observation_periods(spark, sf_dir):
    rows = temporal.periods(s.images(spark, sf_dir).filter("captured_at is not null"))
    return rows.select("acquisition_date", F.array_join(F.transform("images", lambda x: x.cast("string")), ",").alias("images"))


@query("""WITH d AS (SELECT ts::DATE AS acquisition_date, event_id AS id, ts AS captured_at, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT acquisition_date, row_number() OVER (ORDER BY acquisition_date DESC)::INT AS date_rank, captured_at, id FROM d WHERE k = 1 QUALIFY row_number() OVER (ORDER BY acquisition_date DESC) <= 2""")
def latest_two_periods(spark, sf_dir):
    rows = s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("captured_at"))
    return temporal.latest_two(rows)


@query("""WITH d AS (SELECT user_id AS session_id, ts::DATE AS acquisition_date, event_id AS id, ts AS captured_at, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT session_id, acquisition_date, row_number() OVER (PARTITION BY session_id ORDER BY acquisition_date DESC)::INT AS date_rank, captured_at, id FROM d WHERE k = 1
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY acquisition_date DESC) <= 2""")
def latest_two_per_session(spark, sf_dir):
    rows = s.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("captured_at"))
    return temporal.latest_two(rows, keys=["session_id"])


@query("""WITH p AS (SELECT o_custkey AS session_id, o_orderkey AS after_id, o_orderdate AS after_at, lag(o_orderkey) OVER w AS before_id, lag(o_orderdate) OVER w AS before_at FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT session_id, after_id, before_id, before_at, after_at, date_diff('day', before_at::DATE, after_at::DATE) AS interval_days FROM p WHERE after_at > before_at""")
def before_after_interval(spark, sf_dir):
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("captured_at"))
    return temporal.intervals(rows, "session_id")


@query(f"{_BA} SELECT location_id, b.class_name AS before, a.class_name AS after, b.class_name <> a.class_name AS changed FROM b JOIN a USING (location_id)")
def land_cover_change(spark, sf_dir):
    return temporal.class_changes(*_years(spark, sf_dir))


@query(f"{_BA} SELECT location_id, b.n AS before, a.n AS after, a.n - b.n AS change, CASE WHEN a.n > b.n THEN 'bertambah' WHEN a.n < b.n THEN 'berkurang' ELSE 'tetap' END AS direction FROM b JOIN a USING (location_id)")
def count_change(spark, sf_dir):
    return temporal.count_changes(*_years(spark, sf_dir))


_MAG = f"""{_BA}, m AS (SELECT location_id, b.value AS before, a.value AS after, CASE WHEN abs(a.value - b.value) >= 15 THEN 'tinggi' WHEN abs(a.value - b.value) >= 5 THEN 'sedang' ELSE 'rendah' END AS level,
    round_even((a.value - b.value) * 100, 0) / 100 AS change, round_even(abs(a.value - b.value) * 100, 0) / 100 AS magnitude FROM b JOIN a USING (location_id))"""


@query(f"{_MAG} SELECT * FROM m")
def change_magnitude(spark, sf_dir):
    return temporal.magnitudes(*_years(spark, sf_dir)).drop("significant")


@query(f"{_MAG} SELECT location_id, magnitude, magnitude >= 10 AS significant FROM m")
def significant_change(spark, sf_dir):
    return temporal.magnitudes(*_years(spark, sf_dir)).select("location_id", "magnitude", "significant")


@query(f"{_BA} SELECT location_id, b.n AS before, a.n AS after, a.n - b.n AS change FROM b FULL JOIN a USING (location_id)")
def outer_compare(spark, sf_dir):
    return temporal.outer_changes(*_years(spark, sf_dir), key="location_id")


@query(f"{_BA} SELECT location_id, 'before' AS side FROM b ANTI JOIN a USING (location_id) UNION ALL SELECT location_id, 'after' AS side FROM a ANTI JOIN b USING (location_id)")
def location_mismatch(spark, sf_dir):
    return temporal.mismatched(*_years(spark, sf_dir))


@query("""WITH e AS (SELECT user_id, event_id, -round(value * 16) / 16 AS score FROM events), w AS (SELECT *, count(*) OVER p - 1 AS n, sum(score) OVER p AS s, sum(score * score) OVER p AS q FROM e WINDOW p AS (PARTITION BY user_id)),
    l AS (SELECT *, CASE WHEN n > 0 THEN (s - score) / n ELSE 0 END AS m, CASE WHEN n > 0 THEN sqrt(greatest((q - score * score) / n - ((s - score) / n) ** 2, 0)) ELSE 0 END AS d FROM w)
    SELECT event_id AS id, n AS others_n, CASE WHEN n < 5 OR d = 0 THEN score < 20 ELSE (score - m) / d < -1.5 END AS is_blurry FROM l""")
def blur_leave_one_out(spark, sf_dir):
    rows = s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), (-F.round(F.col("value") * 16) / 16).alias("score"))
    out = blur.leave_one_out(rows)
    return out.select("id", "others_n", blur.is_blurry(*(F.col(c) for c in ("score", "others_mean", "others_std", "others_n"))).alias("is_blurry"))


@query("""WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'dng' ELSE 'jpeg' END AS format, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 <> 0 THEN p_partkey - 1 END AS raw_sibling_id, p_size > 40 AS is_blurry FROM part)
    SELECT i.id, i.format, CASE WHEN i.format = 'dng' AND j.id IS NOT NULL THEN j.is_blurry ELSE i.is_blurry END AS is_blurry FROM i LEFT JOIN i j ON i.raw_sibling_id = j.id""")
def sibling_mirror(spark, sf_dir):
    k = F.col("p_partkey")
    rows = s.table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "dng").otherwise("jpeg").alias("format"), F.when((k % 2 == 0) & (k % 6 != 0), k - 1).alias("raw_sibling_id"), (F.col("p_size") > 40).alias("is_blurry"))
    return blur.mirrored(rows).select("id", "format", "is_blurry")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS known FROM d WHERE doc_id % 10 = 0 GROUP BY h), f AS (SELECT h, min(doc_id) AS first FROM d WHERE doc_id % 10 <> 0 GROUP BY h)
    SELECT doc_id AS seq, CASE WHEN known IS NOT NULL THEN known::VARCHAR WHEN doc_id <> first THEN first::VARCHAR END AS duplicate_of FROM d JOIN f USING (h) LEFT JOIN k USING (h) WHERE doc_id % 10 <> 0""")
def import_dedup(spark, sf_dir):
    rows = s.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    old = rows.filter("seq % 10 = 0").select(F.col("seq").alias("image_id"), "content_hash")
    return imports.plan(rows.filter("seq % 10 <> 0"), old).select("seq", "duplicate_of")


@query("""WITH f AS (SELECT doc_id AS id, (doc_id // 3)::VARCHAR AS stem, CASE WHEN doc_id % 5 < 2 THEN 'jpeg' WHEN doc_id % 5 < 4 THEN 'dng' ELSE 'other' END AS format FROM documents)
    SELECT stem, max(id) FILTER (format = 'jpeg') AS jpeg_id, max(id) FILTER (format = 'dng') AS dng_id FROM f GROUP BY stem HAVING count(*) FILTER (format = 'jpeg') = 1 AND count(*) FILTER (format = 'dng') = 1""")
def pair_siblings(spark, sf_dir):
    k = F.col("doc_id")
    rows = s.table(spark, sf_dir, "documents").select(k.alias("id"), F.floor(k / 3).cast("string").alias("stem"), F.when(k % 5 < 2, "jpeg").when(k % 5 < 4, "dng").otherwise("other").alias("format"))
    return imports.siblings(rows)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphan_files(spark, sf_dir):
    return imports.orphans(s.table(spark, sf_dir, "documents").select("doc_id"), s.table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query(f"""WITH {s.IMAGES} SELECT id, concat_ws(',', CASE WHEN captured_at IS NULL THEN 'captured_at' END, CASE WHEN latitude IS NULL THEN 'latitude' END, CASE WHEN longitude IS NULL THEN 'longitude' END) AS missing FROM images WHERE captured_at IS NULL OR latitude IS NULL OR longitude IS NULL""")
def incomplete_metadata(spark, sf_dir):
    fields = ["captured_at", "latitude", "longitude"]
    return imports.completeness(s.images(spark, sf_dir), fields, fields).filter(F.size("missing_required") > 0).select("id", F.concat_ws(",", "missing_required").alias("missing"))


@query(f"""WITH {s.IMAGES} SELECT c_custkey AS id, coalesce(min(captured_at), TIMESTAMP '2000-01-01') AS date_start, coalesce(max(captured_at), TIMESTAMP '2000-01-01') AS date_end FROM customer LEFT JOIN images ON session_id = c_custkey GROUP BY c_custkey""")
def session_range(spark, sf_dir):
    rows = s.sessions(spark, sf_dir).withColumn("created_at", F.lit("2000-01-01").cast("timestamp_ntz"))
    return temporal.session_range(rows, s.images(spark, sf_dir)).select("id", "date_start", "date_end")


@query("SELECT event_id AS id, 'Session - ' || strftime(ts, '%Y-%m-%d %H:%M') AS name, greatest(date_diff('day', ts::DATE, DATE '2024-06-01'), 0)::INT AS age_days FROM events")
def session_names(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), times.session_name(F.col("ts")).alias("name"), times.age_days(F.col("ts"), F.lit("2024-06-01").cast("date")).alias("age_days"))


@query("""SELECT doc_id, lower(regexp_extract(list_last(string_split(source || '/Doc ' || doc_id || '.JPG', '/')), '\\.([^.]*)$', 1)) AS ext, replace(source || '/Doc ' || doc_id || '.JPG', ' ', '_') AS safe_name, left('id-' || lpad(doc_id::VARCHAR, 8, '0'), 8) AS short FROM documents""".replace("replace(source || '/Doc ' || doc_id || '.JPG', ' ', '_')", "regexp_replace(source || '/Doc ' || doc_id || '.JPG', '[^\\p{L}\\p{N}._-]', '_', 'g')"))
def file_names(spark, sf_dir):
    path = F.concat(F.col("source"), F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".JPG"))
    rows = s.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", text.extension(F.col("path")).alias("ext"), text.safe_file_name(F.col("path")).alias("safe_name"), text.short_id(F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).alias("short"))
