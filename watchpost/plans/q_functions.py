"""Queries for scalar functions: every row of a table through every function."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..functions import signature as S
from ..functions import sql as sql_functions
from ..functions import text as T
from ..functions import timefn as TF
from ..operators.ordered import neighbours, with_chunks
from . import fixtures as X
from .registry import query

BOX = ("x1", "y1", "x2", "y2")
GBOX = ("gx1", "gy1", "gx2", "gy2")


@query("fn_box_measures", X.with_sql(X.BOXES) + """
SELECT box_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area,
 (x1 + x2) / 2 AS centre_x, (y1 + y2) / 2 AS centre_y, (x1 + x2) / 2 AS foot_x, y2 AS foot_y,
 round(((x1 + x2) / 2) / 640, 6) AS norm_x, round(y2 / 480, 6) AS norm_y,
 object_class = 'person' AND (x2 - x1) >= 24 AND (y2 - y1) >= 12 AND (y2 - y1) / (x2 - x1) < 0.9 AS low_profile
FROM boxes""")
def fn_box_measures(spark, sf):
    b = X.boxes_pred(spark, sf)
    c = [F.col(k) for k in BOX]
    centre, foot = G.box_centre(*c), G.box_foot(*c)
    n = G.normalised(foot["x"], foot["y"], F.lit(640), F.lit(480))
    return b.select(
        "box_id", G.box_width(c[0], c[2]).alias("width"), G.box_height(c[1], c[3]).alias("height"),
        G.box_area(*c).alias("area"), centre["x"].alias("centre_x"), centre["y"].alias("centre_y"),
        foot["x"].alias("foot_x"), foot["y"].alias("foot_y"),
        X.r6(n["x"]).alias("norm_x"), X.r6(n["y"]).alias("norm_y"),
        L.low_profile(F.col("object_class"), *c).alias("low_profile"))


@query("fn_box_iou", X.with_sql(X.BOXES, X.GT) + f"""
SELECT box_id, gt_id, round({X.sql_iou(BOX, GBOX)}, 6) AS iou
FROM boxes JOIN gt ON gt.gt_id = 'g' || boxes.box_id AND gt.obj = boxes.obj""")
def fn_box_iou(spark, sf):
    p, g = X.boxes_pred(spark, sf), X.boxes_gt(spark, sf)
    j = p.join(g.drop("frame", "clip", "obj"), F.col("gt_id") == F.concat(F.lit("g"), "box_id"))
    iou = G.box_iou(tuple(F.col(k) for k in BOX), tuple(F.col(k) for k in GBOX))
    return j.select("box_id", "gt_id", X.r6(iou).alias("iou"))


@query("fn_zone_geometry", X.with_sql(X.OBS, X.ZONES) + f"""
SELECT event_id, zone_id, {X.sql_inside('x', 'y', 'points')} AS inside,
 round({X.sql_distance('x', 'y', 'points')}, 6) AS distance,
 CAST({X.sql_side('x', 'y', 'points')} AS INT) AS side,
 round(list_sum(list_transform(range(1, len(points)), lambda i: sqrt(
   pow(points[i+1].x - points[i].x, 2) + pow(points[i+1].y - points[i].y, 2)))), 6) AS outline_length
FROM obs JOIN zones USING (camera_id) WHERE enabled""")
def fn_zone_geometry(spark, sf):
    j = X.obs(spark, sf).join(X.zones(spark).where("enabled"), "camera_id")
    x, y, pts = F.col("x"), F.col("y"), F.col("points")
    return j.select("event_id", "zone_id", G.point_in_polygon(x, y, pts).alias("inside"),
                    X.r6(G.distance_to_polyline(x, y, pts)).alias("distance"),
                    G.side_of_line(x, y, F.get(pts, F.lit(0)), F.get(pts, F.lit(1))).cast("int").alias("side"),
                    X.r6(G.polyline_length(pts)).alias("outline_length"))


@query("fn_track_steps", X.with_sql(X.OBS) + """, step AS (SELECT *,
 lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs
 WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id)),
 h AS (SELECT *, CASE WHEN abs(x - px) < 1e-9 AND abs(y - py) < 1e-9 THEN NULL
  ELSE (degrees(atan2(-(y - py), x - px)) + 360e0) % 360e0 END AS heading FROM step WHERE px IS NOT NULL)
SELECT event_id, round(heading, 4) AS heading,
 round(least((heading - 270 + 720) % 360e0, 360 - (heading - 270 + 720) % 360e0), 4) AS off_west,
 CASE WHEN heading IS NULL THEN 'stationary' ELSE
  (['East','North-East','North','North-West','West','South-West','South','South-East'])[
   CAST(floor((heading + 22.5) / 45) AS INT) % 8 + 1] END AS compass,
 ((((0.55 - 0.5) * (py - 0) - (1 - 0) * (px - 0.5)) > 0) <> (((0.55 - 0.5) * (y - 0) - (1 - 0) * (x - 0.5)) > 0))
 AND ((((x - px) * (0 - py) - (y - py) * (0.5 - px)) > 0) <> (((x - px) * (1 - py) - (y - py) * (0.55 - px)) > 0))
  AS crosses_wire
FROM h""")
def fn_track_steps(spark, sf):
    o = with_chunks(X.obs(spark, sf), ["camera_id", "track_id"], "ts_us", 90 * X.DAY_US)
    s = neighbours(o, ["camera_id", "track_id"], ["ts_us", "event_id"], back={"px": "x", "py": "y"})
    s = s.where("px IS NOT NULL")
    h = G.heading_deg(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    wire = ((F.lit(0.5), F.lit(0.0)), (F.lit(0.55), F.lit(1.0)))
    cross = G.segments_intersect((F.col("px"), F.col("py")), (F.col("x"), F.col("y")), *wire)
    return s.withColumn("h", h).select(
        "event_id", F.round("h", 4).alias("heading"),
        F.round(G.angular_difference(F.col("h"), F.lit(270.0)), 4).alias("off_west"),
        G.compass_label(F.col("h")).alias("compass"), cross.alias("crosses_wire"))


@query("fn_class_bands", X.with_sql(X.OBS) + """, b AS (SELECT *, (event_id * 37 % 1000) / 1000 AS score,
 CAST(event_id % 300 AS DOUBLE) AS ppm, CAST(event_id % 24 AS INT) AS model_index FROM obs)
SELECT event_id, object_class IN ('car', 'motorcycle', 'bus', 'truck') AS vehicle,
 CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.45 THEN 'medium'
  WHEN score >= 0.25 THEN 'low' ELSE 'info' END AS priority,
 CASE WHEN score >= 0.85 THEN 4 WHEN score >= 0.65 THEN 3 WHEN score >= 0.45 THEN 2
  WHEN score >= 0.25 THEN 1 ELSE 0 END AS rank,
 CASE WHEN ppm >= 250 THEN 'identify' WHEN ppm >= 125 THEN 'recognise' WHEN ppm >= 62 THEN 'observe'
  WHEN ppm >= 25 THEN 'detect' ELSE 'monitor' END AS dori,
 ppm >= 62 AS satisfies_observe,
 CASE model_index WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle'
  WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' WHEN 8 THEN 'boat' WHEN 15 THEN 'cattle' WHEN 16 THEN 'cattle'
  WHEN 17 THEN 'cattle' WHEN 18 THEN 'cattle' WHEN 19 THEN 'cattle' WHEN 20 THEN 'cattle'
  WHEN 21 THEN 'cattle' END AS mapped_class FROM b""")
def fn_class_bands(spark, sf):
    o = X.obs(spark, sf)
    score, ppm = (F.col("event_id") * 37 % 1000) / 1000.0, (F.col("event_id") % 300).cast("double")
    pr, dori = L.priority_of_score(score), L.dori_of_density(ppm)
    return o.select("event_id", L.is_vehicle(F.col("object_class")).alias("vehicle"), pr.alias("priority"),
                    L.priority_rank(pr).alias("rank"), dori.alias("dori"),
                    L.dori_satisfies(dori, F.lit("observe")).alias("satisfies_observe"),
                    L.class_of_index((F.col("event_id") % 24).cast("int")).alias("mapped_class"))


_GRANTS = [("click", "person_detection"), ("click", "vehicle_detection"), ("error", "person_detection"),
           ("purchase", "animal_detection"), ("signup", "vehicle_detection"), ("view", "person_detection"),
           ("view", "animal_detection")]


@query("fn_class_gate", X.with_sql(X.OBS, X.values_sql("grants", "camera_id, capability", _GRANTS)) + """
SELECT event_id, camera_id, object_class FROM obs WHERE EXISTS (SELECT 1 FROM grants g
 WHERE g.camera_id = obs.camera_id AND g.capability = CASE object_class WHEN 'person' THEN 'person_detection'
  WHEN 'car' THEN 'vehicle_detection' WHEN 'truck' THEN 'vehicle_detection'
  WHEN 'cattle' THEN 'animal_detection' END)""")
def fn_class_gate(spark, sf):
    g = spark.createDataFrame(_GRANTS, "camera_id string, capability string")
    o = X.obs(spark, sf).withColumn("capability", L.capability_of_class(F.col("object_class")))
    return o.join(g, ["camera_id", "capability"], "left_semi").select("event_id", "camera_id", "object_class")


@query("fn_plate_text", X.with_sql(X.OBS, X.SIGHTINGS) + """, k AS (SELECT *,
 upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS plate_key FROM sightings)
SELECT event_id, plate_key, regexp_matches(plate_key, '^([A-Z]{2})(\\d{1,2})([A-Z]{0,3})(\\d{1,4})$') AS valid,
 CASE WHEN regexp_matches(plate_key, '^([A-Z]{2})(\\d{1,2})([A-Z]{0,3})(\\d{1,4})$') THEN
  regexp_replace(regexp_replace(plate_key, '^([A-Z]{2})(\\d{1,2})([A-Z]{0,3})(\\d{1,4})$', '\\1 \\2 \\3 \\4'), ' +', ' ', 'g')
  ELSE plate_key END AS spaced,
 CASE WHEN regexp_matches('XX' || raw || 'Z9', '[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}')
  AND regexp_extract('XX' || plate_key || 'Z9', '[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}') <> ''
  THEN regexp_extract('XX' || plate_key || 'Z9', '[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}')
  ELSE coalesce(nullif(regexp_extract('XX' || plate_key || 'Z9', '[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{4}'), ''),
   'XX' || plate_key || 'Z9') END AS in_noise FROM k""")
def fn_plate_text(spark, sf):
    s = X.sightings(spark, sf)
    raw = F.col("raw")
    return s.select("event_id", T.plate_key(raw).alias("plate_key"), T.plate_valid(raw).alias("valid"),
                    T.plate_spaced(raw).alias("spaced"),
                    T.plate_in_noise(F.concat(F.lit("xx-"), raw, F.lit(" z9"))).alias("in_noise"))


@query("fn_mean_confidence", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round((l_discount + l_tax + CASE WHEN l_linenumber > 2 THEN l_quantity / 50 ELSE 0 END)
  / (2 + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END), 6) AS mean_conf FROM lineitem""")
def fn_mean_confidence(spark, sf):
    li = X.table(spark, sf, "lineitem")
    vals = F.array("l_discount", "l_tax", F.when(F.col("l_linenumber") > 2, F.col("l_quantity") / 50))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     X.r6(L.mean_confidence(vals)).alias("mean_conf"))


@query("fn_roster_time", X.with_sql(X.OBS) + """, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS mi,
 CAST(isodow(ts) - 1 AS INT) AS wd FROM obs),
 g AS (SELECT *, CASE WHEN wd NOT IN (0, 2, 4) AND NOT ((wd + 6) % 7 IN (0, 2, 4) AND mi <= 75)
   THEN CAST('inf' AS DOUBLE) WHEN mi >= 1350 OR mi <= 75 THEN 0
   ELSE least(least(abs(mi - 1350), 1440 - abs(mi - 1350)), least(abs(mi - 75), 1440 - abs(mi - 75))) END AS gap FROM m)
SELECT event_id, CAST(wd * 24 + hour(ts) AS INT) AS hour_of_week,
 CASE WHEN isinf(gap) THEN -1e0 ELSE CAST(gap AS DOUBLE) END AS minutes_off,
 'P9:' || strftime(CASE WHEN mi <= 75 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d') || ':1350' AS occurrence
FROM g""")
def fn_roster_time(spark, sf):
    o = X.obs(spark, sf)
    ts, days = F.col("ts"), F.array(F.lit(0), F.lit(2), F.lit(4))
    gap = TF.minutes_outside(ts, days, F.lit(1350), F.lit(75))
    return o.select("event_id", TF.hour_of_week(ts).alias("hour_of_week"),
                    F.when(gap == float("inf"), -1.0).otherwise(gap).alias("minutes_off"),
                    TF.window_occurrence(F.lit("P9"), ts, F.lit(1350), F.lit(75)).alias("occurrence"))


@query("fn_redaction", """SELECT c_custkey AS camera_id,
 'rtsp://***@10.0.' || (c_nationkey) || '.7/live?u=' || lower(c_mktsegment) AS stream_url FROM customer""")
def fn_redaction(spark, sf):
    """Camera registry rows with stream credentials hidden and secrets dropped."""
    c = X.table(spark, sf, "customer")
    url = F.concat(F.lit("rtsp://"), F.col("c_name"), F.lit(":pw"), F.col("c_custkey").cast("string"),
                   F.lit("@10.0."), F.col("c_nationkey").cast("string"), F.lit(".7/live?u="), F.lower("c_mktsegment"))
    return (c.select(F.col("c_custkey").alias("camera_id"), T.redact_url(url).alias("stream_url"),
                     F.col("c_name").alias("stream_user")).drop("stream_user"))


@query("fn_edge_timing", X.with_sql(X.OBS) + """, g AS (SELECT event_id,
 (ts_us - lag(ts_us) OVER (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id)) / 1e6 AS gap FROM obs)
SELECT event_id, round(exp(-0.5 * pow((gap - 200000) / 90000, 2)), 6) AS timing,
 gap BETWEEN greatest(1, 200000 - 2.5 * 90000) AND 200000 + 2.5 * 90000 AS in_window,
 CASE WHEN abs(gap - 200000) < 2 THEN 1e0 ELSE 0e0 END AS fixed_timing
FROM g WHERE gap IS NOT NULL""")
def fn_edge_timing(spark, sf):
    keys = ["camera_id", "track_id"]
    o = with_chunks(X.obs(spark, sf), keys, "ts_us", 90 * X.DAY_US)
    g = neighbours(o, keys, ["ts_us", "event_id"], back={"prev_us": "ts_us"}).where("prev_us IS NOT NULL")
    gap = (F.col("ts_us") - F.col("prev_us")) / 1e6
    mean, std = F.lit(200000.0), F.lit(90000.0)
    return g.select("event_id", X.r6(S.timing_score(gap, mean, std)).alias("timing"),
                    gap.between(S.window_low(mean, std, 2.5), S.window_high(mean, std, 2.5)).alias("in_window"),
                    S.timing_score(gap, mean, F.lit(0.0)).alias("fixed_timing"))


@query("fn_similarity", X.with_sql(X.CROPS) + """, p AS (SELECT a.vec_id, a.vector AS u, b.vector AS v
 FROM crops a JOIN crops b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: CAST(least(u[i], v[i]) AS DOUBLE))) / 2, 4)
  AS intersection,
 round((list_sum(list_transform(range(1, len(u) + 1), lambda i: CAST(u[i] AS DOUBLE) * CAST(v[i] AS DOUBLE)))
  / sqrt(list_sum(list_transform(u, lambda q: CAST(q AS DOUBLE) * CAST(q AS DOUBLE)))
     * list_sum(list_transform(v, lambda q: CAST(q AS DOUBLE) * CAST(q AS DOUBLE)))) + 1) / 2, 4) AS cosine FROM p""")
def fn_similarity(spark, sf):
    c = X.crops(spark, sf)
    nxt = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("v"))
    j = c.join(nxt, "vec_id")
    return j.select("vec_id", F.round(S.similarity(F.col("vector"), F.col("v")), 4).alias("intersection"),
                    F.round(S.similarity(F.col("vector"), F.col("v"), "embedding"), 4).alias("cosine"))


@query("fn_mask_refinement", X.with_sql(X.OBS, X.ZONES) + f""", m AS (SELECT camera_id, track_id, zone_id,
 avg(CASE WHEN {X.sql_inside('x', 'y', 'points')} THEN 1e0 ELSE 0e0 END) AS mask_fraction,
 count(*) AS mask_points, bool_or({X.sql_inside('x', 'y', 'points')} AND event_id % 2 = 0) AS contact_in_zone
 FROM obs JOIN zones USING (camera_id) WHERE kind = 'polygon' AND enabled GROUP BY ALL)
SELECT camera_id, track_id, zone_id, round(mask_fraction, 6) AS mask_fraction, mask_points, contact_in_zone,
 CASE WHEN mask_fraction >= 0.5 AND contact_in_zone THEN 0.08e0 WHEN mask_fraction >= 0.15 THEN 0.03e0
  WHEN track_id % 2 = 0 AND mask_fraction < 0.05 THEN -0.06e0 ELSE 0e0 END AS adjustment FROM m""")
def fn_mask_refinement(spark, sf):
    """Mask points of each object against each polygon, then the score nudge."""
    j = X.obs(spark, sf).join(X.zones(spark).where("kind = 'polygon' AND enabled"), "camera_id")
    j = j.withColumn("hit", G.point_in_polygon(F.col("x"), F.col("y"), F.col("points")))
    m = j.groupBy("camera_id", "track_id", "zone_id").agg(
        F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("f"), F.count("*").alias("mask_points"),
        F.bool_or(F.col("hit") & (F.col("event_id") % 2 == 0)).alias("contact_in_zone"))
    return m.select("camera_id", "track_id", "zone_id", X.r6(F.col("f")).alias("mask_fraction"), "mask_points",
                    "contact_in_zone", L.refinement_adjustment(
                        F.col("f"), F.col("contact_in_zone"), F.col("track_id") % 2 == 0).alias("adjustment"))


@query("fn_sql_functions", X.with_sql(X.OBS, X.ZONES) + f"""SELECT event_id, zone_id, {X.sql_inside('x', 'y', 'points')} AS inside, round({X.sql_distance('x', 'y', 'points')}, 6) AS distance,
 CASE WHEN hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) <= 75 THEN 0e0 ELSE CAST(least(abs(hour(ts) * 60 + minute(ts) - 1350), 1440 - abs(hour(ts) * 60 + minute(ts) - 1350),
 abs(hour(ts) * 60 + minute(ts) - 75), 1440 - abs(hour(ts) * 60 + minute(ts) - 75)) AS DOUBLE) END AS minutes_off FROM obs JOIN zones USING (camera_id) WHERE enabled""")
def fn_sql_functions(spark, sf):
    """The session's SQL functions in a plain SQL query."""
    sql_functions.register(spark)
    return spark.sql("""SELECT event_id, zone_id, point_in_polygon(x, y, points) AS inside, round(distance_to_polyline(x, y, points), 6) AS distance,
        minutes_outside(ts, CAST(array() AS ARRAY<INT>), 1350, 75) AS minutes_off
        FROM {obs} JOIN {zones} USING (camera_id) WHERE enabled""", obs=X.obs(spark, sf), zones=X.zones(spark))
