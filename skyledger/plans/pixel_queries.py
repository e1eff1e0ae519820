"""Pixels, geometry, detections and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, indices, numeric
from ..operators import blur, detections, outlines, pixels
from . import standins as s
from .registry import query

_R = "(r / 255.0::DOUBLE)"
_G, _B = _R.replace("r /", "g /"), _R.replace("r /", "b /")


def _scaled(df):
    return df.select("img", "x", "y", *((F.col(c) / 255.0).alias(c) for c in "rgb"))


@query(f"""WITH {s.PIXELS}, c AS (SELECT img, count(*) AS total_pixels, count(*) FILTER (2 * g - r - b > 20) AS vegetation_pixels FROM px GROUP BY img)
    SELECT img, total_pixels, vegetation_pixels, round(vegetation_pixels * 100.0::DOUBLE / total_pixels, 6) AS coverage_percentage, CASE WHEN vegetation_pixels * 100.0 / total_pixels <= 30 THEN 'low' WHEN vegetation_pixels * 100.0 / total_pixels <= 60 THEN 'medium' ELSE 'high' END AS coverage_class FROM c""")
def coverage_class(spark, sf_dir):
    out = pixels.coverage(s.pixels(spark, sf_dir), indices.is_vegetation(F.col("r"), F.col("g"), F.col("b")), "img")
    return out.withColumn("coverage_class", indices.coverage_class(F.col("coverage_percentage"))).withColumn("coverage_percentage", F.round("coverage_percentage", 6))


@query(f"""WITH {s.PIXELS}, q AS (SELECT img, {_R} AS r, {_G} AS g, {_B} AS b FROM px) SELECT img, count(*) FILTER (2 * g - r - b > 0.1) AS exg, count(*) FILTER (1.4 * r - g > 0) AS exr, count(*) FILTER ((g - r) / (g + r - b + 1e-6) > 0.03) AS vari FROM q GROUP BY img""")
def index_masks(spark, sf_dir):
    rows = _scaled(s.pixels(spark, sf_dir))
    bands = [F.col(c) for c in "rgb"]
    return rows.groupBy("img").agg(*(F.count_if(indices.masked(indices.coverage_index(m, *bands), t)).alias(m) for m, t in indices.THRESHOLDS.items()))


_CANOPY = "(2 * g - r - b) / (r + g + b + 1e-6) > 0.05 AND g > r AND (r + g + b + 1e-6) / 3 > 0.08 AND (r + g + b + 1e-6) / 3 < 0.92"
_VARI = "least(greatest((g - r) / CASE WHEN abs(g + r - b) < 1e-6 THEN 1e-6 ELSE g + r - b END, -1.0::DOUBLE), 1.0::DOUBLE)"


@query(f"""WITH {s.PIXELS}, q AS (SELECT img, {_R} AS r, {_G} AS g, {_B} AS b FROM px), c AS (SELECT img, {_CANOPY} AS canopy, {_VARI} AS v FROM q), n AS (SELECT img, count(*) FILTER (canopy) AS canopy_pixels, count(*) FILTER (canopy AND v >= 0.15) AS vigorous, count(*) FILTER (canopy AND v >= 0.05 AND v < 0.15) AS moderate, count(*) FILTER (canopy AND v < 0.05) AS severe FROM c GROUP BY img)
    SELECT *, CASE WHEN canopy_pixels = 0 THEN 'none' WHEN vigorous >= moderate AND vigorous >= severe THEN 'vigorous' WHEN moderate >= severe THEN 'moderate' ELSE 'severe' END AS dominant FROM n""")
def canopy_condition(spark, sf_dir):
    bands = [F.col(c) for c in "rgb"]
    canopy = indices.is_canopy(*bands)
    out = pixels.condition_stats(_scaled(s.pixels(spark, sf_dir)), indices.condition(indices.vari(*bands), canopy), canopy, "img")
    return out.select("img", "canopy_pixels", "vigorous", "moderate", "severe", indices.dominant(F.col("vigorous"), F.col("moderate"), F.col("severe")).alias("dominant"))


@query(f"""WITH {s.PIXELS}, q AS (SELECT img, {_R} AS r, {_G} AS g, {_B} AS b FROM px) SELECT img, round(avg(g), 6) AS mean_green, round(stddev_pop(g), 6) AS std_green, max(g) AS max_green FROM q WHERE {_CANOPY} GROUP BY img""")
def canopy_colour(spark, sf_dir):
    rows = _scaled(s.pixels(spark, sf_dir)).filter(indices.is_canopy(*(F.col(c) for c in "rgb")))
    return rows.groupBy("img").agg(F.round(F.avg("g"), 6).alias("mean_green"), F.round(F.stddev_pop("g"), 6).alias("std_green"), F.max("g").alias("max_green"))


@query(f"""WITH {s.PIXELS}, g AS (SELECT img, row, col FROM (SELECT DISTINCT img FROM px), (SELECT range AS row FROM range(7)), (SELECT range AS col FROM range(7))), c AS (SELECT img, floor(((y + 1) * 7 - 1) / 48)::INT AS row, floor(((x + 1) * 7 - 1) / 64)::INT AS col, 2 * g - r - b > 20 AS m FROM px),
    n AS (SELECT img, row, col, count(*) AS t, count(*) FILTER (m) AS v FROM c GROUP BY ALL) SELECT img, row::INT AS row, col::INT AS col, coalesce(t, 0) AS total_pixels, coalesce(v, 0) AS vegetation_pixels, CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE round(v * 100.0::DOUBLE / t, 6) END AS coverage_percentage FROM g LEFT JOIN n USING (img, row, col)""")
def zonation(spark, sf_dir):
    mask = indices.is_vegetation(F.col("r"), F.col("g"), F.col("b"))
    return pixels.zonation(s.pixels(spark, sf_dir), 64, 48, 7, mask, "img").withColumn("coverage_percentage", F.round("coverage_percentage", 6))


_GRIDS = f"WITH {s.grid_sql(False, 'b')}, {s.grid_sql(True, 'a')}"


@query(f"{_GRIDS} SELECT img, count(*) FILTER (NOT b.mask AND a.mask) AS gain_pixels, count(*) FILTER (b.mask AND NOT a.mask) AS loss_pixels, count(*) AS cells FROM b JOIN a USING (img, x) WHERE b.y = a.y - 1 GROUP BY img")
def change_grid(spark, sf_dir):
    after = s.grid(spark, sf_dir, True).withColumn("y", F.col("y") - 1)
    out = pixels.change_grid(s.grid(spark, sf_dir, False), after, "img")
    return out.groupBy("img").agg(F.count_if(F.col("change") == "gain").alias("gain_pixels"), F.count_if(F.col("change") == "loss").alias("loss_pixels"), F.count("*").alias("cells"))


_CHANGED = f"""{s.grid_sql(False, "a")}, {s.grid_sql(True, "b0")}, b AS (SELECT img, x, y - 1 AS y, mask FROM b0),
    c AS (SELECT img, x::BIGINT AS x, y::BIGINT AS y, CASE WHEN NOT a.mask AND b.mask THEN 'gain' WHEN a.mask AND NOT b.mask THEN 'loss' END AS change FROM a JOIN b USING (img, x, y)),
    r AS (SELECT img, change, x, y, x AS rx, y AS ry FROM c WHERE change IS NOT NULL
          UNION SELECT c.img, c.change, c.x, c.y, r.rx, r.ry FROM r JOIN c ON c.img = r.img AND c.change = r.change AND abs(c.x - r.x) + abs(c.y - r.y) = 1),
    l AS (SELECT img, change, x, y, min((ry, rx)) AS head FROM r GROUP BY img, change, x, y)"""


@query(f"""WITH RECURSIVE {_CHANGED}, p AS (SELECT img, change, head, count(*) AS pixels, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM l GROUP BY img, change, head)
    SELECT img::BIGINT AS img, change, row_number() OVER (PARTITION BY img, change ORDER BY head) - 1 AS patch, pixels, pixels * 2.0::DOUBLE AS area_m2, x_min, y_min, x_max, y_max FROM p WHERE pixels * 2.0 >= 4""")
def change_patches(spark, sf_dir):
    """Connected cells of change, by runs of rows; the SQL spreads from cell to cell."""
    after = s.grid(spark, sf_dir, True).withColumn("y", F.col("y") - 1)
    return detections.change_patches(pixels.change_grid(s.grid(spark, sf_dir, False), after, "img"), 2.0, 4.0)


@query(f"""WITH RECURSIVE {_CHANGED}, n AS (SELECT l.*, (SELECT count(*) FROM l k WHERE k.img = l.img AND k.change = l.change AND abs(k.x - l.x) + abs(k.y - l.y) = 1) AS near FROM l),
    p AS (SELECT img, change, head, count(*) AS cells, sum(4 - near) AS border FROM n GROUP BY img, change, head)
    SELECT img::BIGINT AS img, change, cells, cells::DOUBLE AS ring_area, border::BIGINT AS border, count(*) AS patches FROM p GROUP BY ALL""")
def change_outlines(spark, sf_dir):
    """Outlines of patches: what their rings enclose is the number of their cells, and their length that of the sides without a neighbour."""
    after = s.grid(spark, sf_dir, True).withColumn("y", F.col("y") - 1)
    cells = pixels.change_grid(s.grid(spark, sf_dir, False), after, "img").filter("change is not null").select(F.col("img").cast("long").alias("img"), "change", "x", "y")
    steps = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct((a[0] * b[1] - b[0] * a[1]).alias("twice"), (F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])).alias("side")))
    total = lambda field: F.aggregate("rings", F.lit(0).cast("long"), lambda t, r: t + F.aggregate(steps(r), F.lit(0).cast("long"), lambda u, e: u + e[field]))
    out = outlines.polygons(cells, "img", "change").select("img", "change", "cells", (total("twice") / 2).alias("ring_area"), total("side").alias("border"))
    return out.groupBy("img", "change", "cells", "ring_area", "border").agg(F.count("*").alias("patches"))


_BOX = "(SELECT img, 64 AS a_width, 48 AS a_height, 10.0::DOUBLE AS a_west, -2.0::DOUBLE AS a_south, 10.64::DOUBLE AS a_east, -1.52::DOUBLE AS a_north, 40 + img AS b_width, 30 + img % 7 AS b_height, 10.1 + img / 50.0::DOUBLE AS b_west, -1.9::DOUBLE AS b_south, 10.9::DOUBLE AS b_east, -1.5::DOUBLE AS b_north FROM (SELECT DISTINCT img FROM a))"


@query(f"""WITH {s.grid_sql(False, "a")}, {s.grid_sql(True, "b")}, g AS {_BOX},
    t AS (SELECT *, greatest(a_west, b_west) AS w, greatest(a_south, b_south) AS s, least(a_east, b_east) AS e, least(a_north, b_north) AS n, least(a_width, b_width) AS tw, least(a_height, b_height) AS th FROM g),
    c AS (SELECT t.*, x, y, w + (e - w) * ((x + 0.5::DOUBLE) / tw) AS lon, n + (s - n) * ((y + 0.5::DOUBLE) / th) AS lat FROM (SELECT *, unnest(range(th)) AS y FROM (SELECT *, unnest(range(tw)) AS x FROM t WHERE w < e AND s < n)) t),
    k AS (SELECT img, x, y, greatest(least(floor((lon - a_west) / (a_east - a_west) * a_width), a_width - 1), 0) AS ax, greatest(least(floor((lat - a_north) / (a_south - a_north) * a_height), a_height - 1), 0) AS ay,
                 greatest(least(floor((lon - b_west) / (b_east - b_west) * b_width), b_width - 1), 0) AS bx, greatest(least(floor((lat - b_north) / (b_south - b_north) * b_height), b_height - 1), 0) AS "by" FROM c)
    SELECT k.img, k.x::INT AS x, k.y::INT AS y, CASE WHEN NOT a.mask AND b.mask THEN 'gain' WHEN a.mask AND NOT b.mask THEN 'loss' END AS change
    FROM k LEFT JOIN a ON a.img = k.img AND a.x = ax AND a.y = ay LEFT JOIN b ON b.img = k.img AND b.x = bx AND b.y = "by" """)
def change_over_footprint(spark, sf_dir):
    """Masks of two sizes and places, compared on the grid over what both show."""
    a, b = s.grid(spark, sf_dir, False), s.grid(spark, sf_dir, True)
    d = lambda v: F.lit(float(v))
    grids = a.select("img").distinct().select(
        "img", F.lit(64).alias("a_width"), F.lit(48).alias("a_height"), d(10).alias("a_west"), d(-2).alias("a_south"), d(10.64).alias("a_east"), d(-1.52).alias("a_north"),
        (F.col("img") + 40).alias("b_width"), (F.col("img") % 7 + 30).alias("b_height"), (F.col("img") / 50.0 + 10.1).alias("b_west"), d(-1.9).alias("b_south"), d(10.9).alias("b_east"), d(-1.5).alias("b_north"),
    )
    return pixels.change_over(a, b, grids, "img")


_SUP = "s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (s_suppkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat, s_nationkey FROM supplier)"


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return s.table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 53 % 1600) / 10.0 - 80).alias("lat"), "s_nationkey")


@query(f"""WITH {_SUP}, p AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM s WINDOW w AS (PARTITION BY s_nationkey ORDER BY id)), h AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM p WHERE lon0 IS NOT NULL)
    SELECT id, round(6371008.8 * 2 * atan2(sqrt(h), sqrt(1 - h)), 2) AS meters FROM h""")
def haversine_length(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("id")
    rows = _places(spark, sf_dir).select("*", F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0")).filter("lon0 is not null")
    return rows.select("id", F.round(geo.haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), 2).alias("meters"))


_PLOTS = "pl AS (SELECT s_suppkey AS plot_id, (s_suppkey * 7 % 30)::DOUBLE AS lon, (s_suppkey * 5 % 15)::DOUBLE - 8 AS lat FROM supplier), v AS (SELECT plot_id, k, lon + [0.0, 2.0, 2.5, 0.5, 0.0][k] AS x, lat + [0.0, 0.25, 2.0, 1.5, 0.0][k] AS y FROM pl, (SELECT range AS k FROM range(1, 6))), e AS (SELECT plot_id, k, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY plot_id ORDER BY k) QUALIFY x2 IS NOT NULL)"


@query(f"""WITH {_PLOTS}, a AS (SELECT plot_id, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2)))) * 6371008.8 * 6371008.8 / 2) AS area, sum(6371008.8 * 2 * atan2(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)), sqrt(1 - pow(sin(radians(y2 - y1) / 2), 2) - cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))) AS perimeter FROM e GROUP BY plot_id)
    SELECT plot_id, round(area / 10000, 0) AS area_ha, round(perimeter, 0) AS perimeter_m FROM a""")
def polygon_metrics(spark, sf_dir):
    return s.plots(spark, sf_dir).select("plot_id", F.round(geo.polygon_area(F.col("rings")) / 10000, 0).alias("area_ha"), F.round(geo.polygon_perimeter(F.col("rings")), 0).alias("perimeter_m"))


@query(f"""WITH {_PLOTS}, {s.POINTS}, c AS (SELECT plot_id, point_id, count(*) AS n FROM e JOIN pts ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2) SELECT plot_id, count(*) AS inside FROM c WHERE n % 2 = 1 GROUP BY plot_id""")
def point_in_plot(spark, sf_dir):
    return pixels.counts_in_plots(s.points(spark, sf_dir), s.plots(spark, sf_dir))


@query(f"""WITH {_SUP}, z AS (SELECT id, lon, lat, floor((lon + 180) / 6)::INT + 1 AS zone FROM s), q AS (SELECT *, 0.0066943799901413165 AS e2, 0.006739496742276434 AS ep, radians(lat) AS p FROM z), w AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, ep * cos(p) * cos(p) AS c, radians(lon - ((zone - 1) * 6 - 177)) * cos(p) AS a FROM q)
    SELECT id, zone, round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120) + 500000, 2) AS easting FROM w""")
def project_utm(spark, sf_dir):
    rows = _places(spark, sf_dir).withColumn("zone", (F.floor((F.col("lon") + 180) / 6) + 1).cast("int"))
    return rows.select("id", "zone", F.round(geo.utm(F.col("lat"), F.col("lon"), F.col("zone"), F.col("lat") < 0)["easting"], 2).alias("easting"))


@query(f"WITH {_SUP} SELECT id, round(6378137.0 * radians(lon), 2) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS y FROM s")
def project_mercator(spark, sf_dir):
    m = geo.mercator(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("id", F.round(m["x"], 2).alias("x"), F.round(m["y"], 2).alias("y"))


@query(f"""WITH {_SUP}, f AS (SELECT id, lat, lon, id % 50 AS alt, 4000.0::DOUBLE AS w, 3000.0::DOUBLE AS h FROM s), g AS (SELECT *, 2 * alt * tan(radians(30.0)) AS gw FROM f) SELECT id, CASE WHEN alt > 0 THEN round(lon - gw / 2 / (111320 * cos(radians(lat))), 7) END AS west, CASE WHEN alt > 0 THEN round(lat + gw * h / w / 2 / 111320, 7) END AS north FROM g""")
def footprint_bounds(spark, sf_dir):
    b = geo.footprint(F.col("lat"), F.col("lon"), F.col("id") % 50, F.lit(4000.0), F.lit(3000.0))
    return _places(spark, sf_dir).select("id", F.round(b["west"], 7).alias("west"), F.round(b["north"], 7).alias("north"))


@query("""WITH z AS (SELECT p_partkey AS id, (p_partkey * 97 % 5000 + 1)::INT AS width, (p_partkey * 61 % 5000 + 1)::INT AS height FROM part), n AS (SELECT *, width <= 2048 AND height <= 2048 AS small, greatest(ceil((width - 1024) / 992.0::DOUBLE), 0)::INT AS nc, greatest(ceil((height - 1024) / 992.0::DOUBLE), 0)::INT AS nr FROM z),
    t AS (SELECT *, unnest(range(CASE WHEN small THEN 1 ELSE nr + 1 END)) AS r FROM n), u AS (SELECT *, unnest(range(CASE WHEN small THEN 1 ELSE nc + 1 END)) AS c FROM t)
    SELECT id, width, height, (CASE WHEN small THEN 0 ELSE r * (nc + 1) + c END)::INT AS slice_index, (r * 992)::INT AS row_offset, (c * 992)::INT AS col_offset, (CASE WHEN small THEN width ELSE least(1024, width - c * 992) END)::INT AS slice_width, (CASE WHEN small THEN height ELSE least(1024, height - r * 992) END)::INT AS slice_height FROM u""")
def tile_windows(spark, sf_dir):
    k = F.col("p_partkey")
    rows = s.table(spark, sf_dir, "part").select(k.alias("id"), (k * 97 % 5000 + 1).cast("int").alias("width"), (k * 61 % 5000 + 1).cast("int").alias("height"))
    return pixels.tiles(rows)


@query("""WITH p AS (SELECT l_suppkey % 20 AS img, l_partkey % 6 AS label, round(l_discount * 100) AS c FROM lineitem), t AS (SELECT img, count(*) AS t FROM p GROUP BY img)
    SELECT img, label, count(*) AS pixel_count, round(avg(c), 4) AS mean_confidence, round(count(*) * 100.0::DOUBLE / max(t), 6) AS percentage FROM p JOIN t USING (img) GROUP BY img, label""")
def class_statistics(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("img"), (F.col("l_partkey") % 6).alias("label"), F.round(F.col("l_discount") * 100).alias("confidence"))
    return detections.class_statistics(rows, "label", "confidence", "img").select("img", "label", "pixel_count", F.round("mean_confidence", 4).alias("mean_confidence"), F.round("percentage", 6).alias("percentage"))


@query("""WITH p AS (SELECT l_suppkey % 20 AS img, l_partkey % 6 AS label FROM lineitem) SELECT img, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (label = 2) AS class_2, count(*) FILTER (label = 3) AS class_3, count(*) FILTER (label = 0) AS unclassified FROM p GROUP BY img""")
def class_pivot(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("img"), (F.col("l_partkey") % 6).alias("label"))
    out = rows.groupBy("img").pivot("label", [0, 1, 2, 3]).count().na.fill(0)
    return out.select("img", *(F.col(str(k)).alias(f"class_{k}") for k in (1, 2, 3)), F.col("0").alias("unclassified"))


@query("""WITH l AS (SELECT l_partkey AS segment, l_suppkey % 4 AS label FROM lineitem), n AS (SELECT segment, label, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT segment, sum(n) AS t, sum(n) FILTER (label <> 0) AS m FROM n GROUP BY segment)
    SELECT segment, label AS majority_label FROM n JOIN a USING (segment) WHERE label <> 0 AND m >= 0.5 * t QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, label) = 1""")
def segment_majority(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("segment"), (F.col("l_suppkey") % 4).alias("label"))
    return detections.majority(rows)


def _boxes(spark, sf_dir):
    k, x, y = F.col("l_linenumber"), F.col("l_partkey") * 7 % 200, F.col("l_orderkey") * 11 % 200
    rows = s.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("image_id"), (F.col("l_orderkey") * 8 + k).alias("seq"), x.cast("double").alias("x_min"), y.cast("double").alias("y_min"), (x + 20 + k).cast("double").alias("x_max"), (y + 20 + k).cast("double").alias("y_max"), F.col("l_tax").alias("confidence"))
    return rows.filter("confidence >= 0.05")


_BOXES = """b AS (SELECT l_orderkey // 64 AS image_id, l_orderkey * 8 + l_linenumber AS seq, (l_partkey * 7 % 200)::DOUBLE AS x, (l_orderkey * 11 % 200)::DOUBLE AS y, (20 + l_linenumber)::DOUBLE AS side, l_tax AS c, l_partkey AS part FROM lineitem WHERE l_tax >= 0.05)"""


@query(f"""WITH {_BOXES}, g AS (SELECT image_id, list([{{'seq': seq, 'x': x, 'y': y, 's': side, 'c': c}}] ORDER BY c DESC, seq, x, y, side) AS all_boxes FROM b GROUP BY image_id),
    k AS (SELECT image_id, unnest(list_reduce(all_boxes, lambda kept, e: CASE WHEN len(list_filter(kept, lambda o: least(o.x + o.s, e[1].x + e[1].s) > greatest(o.x, e[1].x) AND least(o.y + o.s, e[1].y + e[1].s) > greatest(o.y, e[1].y)
        AND (least(o.x + o.s, e[1].x + e[1].s) - greatest(o.x, e[1].x)) * (least(o.y + o.s, e[1].y + e[1].s) - greatest(o.y, e[1].y)) > 0.4::DOUBLE * (o.s * o.s + e[1].s * e[1].s - (least(o.x + o.s, e[1].x + e[1].s) - greatest(o.x, e[1].x)) * (least(o.y + o.s, e[1].y + e[1].s) - greatest(o.y, e[1].y))))) > 0 THEN kept ELSE list_concat(kept, e) END)) AS o FROM g)
    SELECT image_id, o.seq AS seq, o.x AS x_min, o.y AS y_min, o.x + o.s AS x_max, o.y + o.s AS y_max, o.c AS confidence FROM k""")
def box_suppression(spark, sf_dir):
    """Suppression by clusters of overlapping boxes; the SQL goes through the boxes of an image one by one."""
    return detections.suppressed(_boxes(spark, sf_dir), 0.4)


@query("SELECT l_orderkey % 97 AS image_id, count(*) AS tree_count, round(avg(round(l_tax * 100)), 4) AS mean_confidence, count(*) * 10000.0::DOUBLE / 50000 AS trees_per_ha FROM lineitem WHERE round(l_tax * 100) >= 3 GROUP BY 1")
def tree_density(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("image_id"), F.round(F.col("l_tax") * 100).alias("confidence")).filter("confidence >= 3")
    return detections.counts(rows, "image_id").select("image_id", "tree_count", F.round("mean_confidence", 4).alias("mean_confidence"), detections.density(F.col("tree_count"), F.lit(50000.0)).alias("trees_per_ha"))


@query(f"""WITH {s.PIXELS}, d AS (SELECT img, x, y, max(g) AS v FROM px GROUP BY ALL), z AS (SELECT img, max(x) AS w, max(y) AS h FROM d GROUP BY img), k AS (SELECT img, x, y, v, [(0, 0)] AS o FROM d), n AS (SELECT d.img, d.x + o.dx AS x, d.y + o.dy AS y, v FROM d, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)),
    c AS (SELECT img, x, y, ((x = 0)::INT + (y = 0)::INT + (x = w)::INT + (y = h)::INT - 4) * v AS v FROM d JOIN z USING (img) UNION ALL SELECT img, x, y, v FROM n JOIN z USING (img) WHERE x BETWEEN 0 AND w AND y BETWEEN 0 AND h), l AS (SELECT img, x, y, sum(v) AS l FROM c GROUP BY ALL) SELECT img, round(var_pop(l), 3) AS blur_score FROM l GROUP BY img""")
def blur_scores(spark, sf_dir):
    rows = s.pixels(spark, sf_dir).groupBy("img", "x", "y").agg(F.max("g").alias("gray"))
    return blur.laplacian_variance(rows).withColumn("blur_score", F.round("blur_score", 3))


@query("""WITH p AS (SELECT l_suppkey % 20 AS img, (l_orderkey * 131 % 65536)::INT AS v FROM lineitem), b AS (SELECT img, v, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT img, v, sum(n) OVER (PARTITION BY img ORDER BY v) AS run, sum(n) OVER (PARTITION BY img) AS t FROM b)
    SELECT img, min(v) FILTER (run >= t * 0.005) AS lo, min(v) FILTER (run >= t * 0.995) AS hi FROM r GROUP BY img""")
def stretch_percentiles(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("img"), (F.col("l_orderkey") * 131 % 65536).cast("int").alias("v"))
    return pixels.percentiles_16bit(rows, "v", 0.005, 0.995, "img").select("img", "lo", "hi")


@query("""WITH c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split('photo-' || doc_id, ''), lambda d: ascii(d)::BIGINT)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc FROM documents)
    SELECT doc_id, crc % 1000 < 200 AS validation FROM c""")
def training_split(spark, sf_dir):
    """A stable split by CRC-32, which the SQL takes bit by bit."""
    return s.table(spark, sf_dir, "documents").select("doc_id", detections.is_validation(F.concat(F.lit("photo-"), F.col("doc_id").cast("string")), 0.2).alias("validation"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 40 > 0 THEN round((s_suppkey % 40) * 43.27 / (23 * sqrt(4000.0 * 4000 + 3000 * 3000)), 6) END AS gsd_focal, CASE WHEN s_suppkey % 40 > 0 THEN round(2 * (s_suppkey % 40) * tan(radians(60.0) / 2) / 4000, 6) END AS gsd_fov FROM supplier""")
def ground_resolution(spark, sf_dir):
    alt = F.col("s_suppkey") % 40
    return s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(numeric.gsd_focal(alt, F.lit(23), F.lit(4000), F.lit(3000)), 6).alias("gsd_focal"), F.round(numeric.gsd_fov(alt, F.lit(60.0), F.lit(4000)), 6).alias("gsd_fov"))
