"""Queries for camera profiling and capability certificates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as P
from ..session import cut
from ..values import CAPABILITY_RULES, ROLE_CAPABILITIES
from . import fixtures as X
from .registry import query

ROLES = list(ROLE_CAPABILITIES)


def people(spark, sf):
    """Confirmed person boxes of twenty cameras, with outliers and clipped boxes."""
    li = X.table(spark, sf, "lineitem")
    cam = (F.col("l_suppkey") % 20).cast("int")
    v = 100 + F.col("l_quantity") * 7 + F.col("l_linenumber") * 0.25
    h = 1.7 / (4.0 + cam % 5) * (v - 60.0) + (F.col("l_linenumber") - 4) * 0.5
    h = F.when(F.col("l_discount") > 0.09, h * 0.4).otherwise(h)
    w = F.when(F.col("l_tax") > 0.07, h * 1.5).otherwise(h / 2.5)
    x1 = 5 + F.col("l_partkey") % 600
    return li.select(cam.alias("camera_id"), x1.cast("double").alias("x1"), (v - h).alias("y1"), (x1 + w).alias("x2"), v.alias("y2"),
                     F.lit("person").alias("object_class"), (F.col("l_partkey") % 20).alias("hits"),
                     F.when(F.col("l_linenumber") % 6 == 0, 1).otherwise(0).alias("lost_frames"),
                     F.lit(640).alias("frame_w"), F.lit(480).alias("frame_h"))


PEOPLE = """ppl0 AS (SELECT CAST(l_suppkey % 20 AS INT) AS camera_id, 100 + l_quantity * 7 + l_linenumber * 0.25e0 AS y2,
  l_linenumber, l_discount, l_tax, l_partkey FROM lineitem),
ppl1 AS (SELECT *, 1.7e0 / (4e0 + camera_id % 5) * (y2 - 60e0) + (l_linenumber - 4) * 0.5e0 AS h0 FROM ppl0),
ppl AS (SELECT *, CASE WHEN l_discount > 0.09 THEN h0 * 0.4e0 ELSE h0 END AS h, CAST(5 + l_partkey % 600 AS DOUBLE) AS x1 FROM ppl1),
ppw AS (SELECT *, CASE WHEN l_tax > 0.07 THEN h * 1.5e0 ELSE h / 2.5e0 END AS w FROM ppl),
gs AS (SELECT camera_id, y2 AS foot_v, y2 - (y2 - h) AS px_height FROM ppw WHERE l_linenumber % 6 <> 0 AND l_partkey % 20 >= 5
 AND y2 < 478 AND y2 - h > 1 AND x1 > 1 AND x1 + w < 638 AND y2 - (y2 - h) >= 8 AND (y2 - (y2 - h)) / (x1 + w - x1) BETWEEN 1.15 AND 9)"""


def samples(spark, sf):
    return P.ground_samples(people(spark, sf))


def frames(spark, sf):
    """One measured frame per order line, twenty cameras, ten frames a second."""
    li = X.table(spark, sf, "lineitem")
    cam = (F.col("l_suppkey") % 20).cast("int")
    return li.select(cam.alias("camera_id"), (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * (cam + 1)).alias("ts_us"),
                     (F.col("l_quantity") + cam * 3).alias("luma"), (F.col("l_partkey") % 90 + cam).cast("double").alias("sharpness"),
                     (F.col("l_discount") + cam * 0.003).alias("eff_res"), (F.col("l_tax") * (cam % 9)).alias("blockiness"),
                     (F.col("l_linenumber") * 1.5 + cam * 0.1).alias("noise"), (5.0 + cam * 3).alias("claimed_fps"),
                     F.lit(640).alias("frame_w"), F.lit(480).alias("frame_h"))


OPTICS = """fr AS (SELECT CAST(l_suppkey % 20 AS INT) AS camera_id, l_orderkey * 100000 + l_linenumber * (l_suppkey % 20 + 1) AS ts_us,
 l_quantity + (l_suppkey % 20) * 3 AS luma, CAST(l_partkey % 90 + l_suppkey % 20 AS DOUBLE) AS sharpness, l_discount + (l_suppkey % 20) * 0.003e0 AS eff_res,
 l_tax * (l_suppkey % 20 % 9) AS blockiness, l_linenumber * 1.5e0 + (l_suppkey % 20) * 0.1e0 AS noise, 5e0 + (l_suppkey % 20) * 3 AS claimed_fps FROM lineitem),
opt AS (SELECT camera_id, count(*) AS frames, max(claimed_fps) AS claimed_fps, avg(luma) AS mean_luma, (count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1e6) AS measured_fps,
 quantile_cont(sharpness, 0.5) AS sharpness, quantile_cont(eff_res, 0.5) AS eff, quantile_cont(blockiness, 0.5) AS block, quantile_cont(noise, 0.5) AS noise FROM fr GROUP BY camera_id)"""
PLANE = """lev AS (SELECT camera_id, count(*) AS samples, quantile_cont(foot_v, 0.05) AS vlo, quantile_cont(foot_v, 0.95) AS vhi,
 quantile_cont(px_height, 0.05) AS plo, quantile_cont(px_height, 0.95) AS phi FROM gs GROUP BY camera_id),
pt AS (SELECT camera_id, foot_v, px_height FROM gs),
sl AS (SELECT x.camera_id, (y.px_height - x.px_height) / (y.foot_v - x.foot_v) AS slope FROM pt x JOIN pt y ON x.camera_id = y.camera_id AND x.foot_v < y.foot_v),
ms AS (SELECT camera_id, quantile_cont(slope, 0.5) AS slope FROM sl GROUP BY camera_id),
fit AS (SELECT m.camera_id, any_value(m.slope) AS slope, quantile_cont(g.px_height - m.slope * g.foot_v, 0.5) AS intercept FROM ms m JOIN gs g USING (camera_id) GROUP BY m.camera_id),
pl AS (SELECT l.*, f.slope, -f.intercept / f.slope AS hy, 1.7e0 / f.slope AS ch, CASE WHEN samples < 9 THEN 'too few observations'
  WHEN vhi - vlo < 48 OR phi / greatest(plo, 1e-6) < 1.6 THEN 'too little depth variation' WHEN f.slope IS NULL OR f.slope <= 1e-6 THEN 'non-physical slope'
  WHEN 1.7e0 / f.slope NOT BETWEEN 0.8 AND 40 THEN 'implausible camera height' END AS reason FROM lev l LEFT JOIN fit f USING (camera_id))"""


@query("profile_ground_samples", X.with_sql(PEOPLE) + "SELECT camera_id, round(foot_v, 4) AS foot_v, round(px_height, 6) AS px_height FROM gs")
def profile_ground_samples(spark, sf):
    return samples(spark, sf).select("camera_id", F.round("foot_v", 4).alias("foot_v"), F.round("px_height", 6).alias("px_height"))


@query("profile_optics", X.with_sql(OPTICS) + """SELECT camera_id, frames, round(mean_luma, 4) AS mean_luma, round(measured_fps, 4) AS measured_fps,
 round(sharpness, 4) AS sharpness, round(eff, 5) AS effective_resolution, round(block, 5) AS blockiness, round(noise, 4) AS noise_sigma, mean_luma < 55 AS is_low_light,
 concat_ws('; ', CASE WHEN 1 - measured_fps / claimed_fps > 0.25 THEN 'frame rate well below claim' END, CASE WHEN eff < 0.06 THEN 'far less detail than the frame size implies' END,
 CASE WHEN block > 0.35 THEN 'heavy block artifacts' END, CASE WHEN noise > 8 THEN 'high sensor noise' END, CASE WHEN mean_luma < 55 THEN 'low-light scene' END) AS notes FROM opt""")
def profile_optics(spark, sf):
    o = P.optics(frames(spark, sf)).withColumn("notes", F.array_join("notes", "; "))
    return o.select("camera_id", "frames", F.round("mean_luma", 4).alias("mean_luma"), F.round("measured_fps", 4).alias("measured_fps"),
                    F.round("sharpness", 4).alias("sharpness"), F.round("effective_resolution", 5).alias("effective_resolution"),
                    F.round("blockiness", 5).alias("blockiness"), F.round("noise_sigma", 4).alias("noise_sigma"), "is_low_light",
                    "notes")


@query("profile_leverage", X.with_sql(PEOPLE, PLANE) + """SELECT camera_id, samples, round(vlo, 4) AS v_lo, round(vhi, 4) AS v_hi,
 vhi - vlo >= 48 AND phi / greatest(plo, 1e-6) >= 1.6 AS has_leverage FROM lev""")
def profile_leverage(spark, sf):
    return P.leverage(samples(spark, sf)).select("camera_id", "samples", F.round("v_lo", 4).alias("v_lo"),
                                                 F.round("v_hi", 4).alias("v_hi"), "has_leverage")


@query("profile_readiness", X.with_sql(PEOPLE, OPTICS, PLANE) + """SELECT camera_id, frames, frames >= 40 AND ((coalesce(samples, 0) >= 28 AND coalesce(vhi - vlo >= 48 AND phi / greatest(plo, 1e-6) >= 1.6, FALSE))
 OR frames >= 600) AS ready FROM opt LEFT JOIN lev USING (camera_id)""")
def profile_readiness(spark, sf):
    return P.readiness(frames(spark, sf), P.leverage(samples(spark, sf))).select("camera_id", "frames", "ready")


@query("profile_line_fit", X.with_sql(PEOPLE, PLANE) + "SELECT camera_id, round(slope, 5) AS slope, round(intercept, 3) AS intercept FROM fit")
def profile_line_fit(spark, sf):
    return P.line_fit(samples(spark, sf)).select("camera_id", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("profile_ground_plane", X.with_sql(PEOPLE, PLANE) + """SELECT camera_id, reason IS NULL AS ground_plane, reason, CASE WHEN reason IS NULL THEN round(ch, 4) END AS camera_height_m,
 CASE WHEN reason IS NULL THEN round(greatest(0, (479 - hy) / ch), 2) ELSE 0 END AS ppm_near, CASE WHEN reason IS NULL THEN round(greatest(0, 0.15e0 * (480 - hy) / ch), 2) ELSE 0 END AS ppm_far FROM pl""")
def profile_ground_plane(spark, sf):
    return P.ground_plane(samples(spark, sf)).select("camera_id", "ground_plane", "reason", F.round("camera_height_m", 4).alias("camera_height_m"),
                                                     "ppm_near", "ppm_far")


@query("profile_height_error", X.with_sql(PEOPLE, PLANE) + """SELECT camera_id, round(abs(ch - (4e0 + camera_id % 5)) / (4e0 + camera_id % 5) * 100, 3) AS height_error_percent FROM pl WHERE reason IS NULL""")
def profile_height_error(spark, sf):
    planes = P.ground_plane(samples(spark, sf)).where("ground_plane")
    truth = planes.select("camera_id", (4.0 + F.col("camera_id") % 5).alias("true_height_m"))
    return P.height_error(planes, truth).select("camera_id", F.round("height_error_percent", 3).alias("height_error_percent"))


def _cameras(spark):
    rows = [(i, ROLES[i % 4], "thermal" if i % 6 == 5 else "optical") for i in range(20)]
    return spark.createDataFrame(rows, "camera_id int, role string, sensor_type string")


_RULES = X.values_sql("rules", "capability, band, px, fine, role, wanted", [
    (cap, band, {"detect": 25.0, "observe": 62.0, "recognise": 125.0, "identify": 250.0}[band], fine, role, cap in ROLE_CAPABILITIES[role])
    for cap, band, fine in CAPABILITY_RULES for role in ROLES])
GRANTS = _RULES + """, cam AS (SELECT CAST(i AS INT) AS camera_id, (['perimeter', 'approach', 'chokepoint', 'riverine'])[i % 4 + 1] AS role, i % 6 = 5 AS thermal FROM range(20) t(i)),
ms2 AS (SELECT p.camera_id, p.reason AS why, round(p.hy, 1) AS hy, round(greatest(0, (479 - p.hy) / p.ch), 2) AS near, o.* EXCLUDE (camera_id)
 FROM pl p JOIN opt o USING (camera_id)),
gr AS (SELECT c.camera_id, c.thermal, r.*, m.*  EXCLUDE (camera_id), (479 - hy) / near AS ht FROM cam c JOIN ms2 m USING (camera_id) JOIN rules r USING (role)),
gg AS (SELECT *, CASE WHEN capability = 'face_recognition' THEN 'withheld by policy' WHEN NOT wanted THEN 'not applicable to this role'
 WHEN why IS NOT NULL OR NOT coalesce(ht > 0, FALSE) THEN 'ground plane unknown' WHEN hy + px * ht >= 480 THEN 'pixel density never reached'
 WHEN eff < CASE WHEN fine THEN 0.07 ELSE 0.018 END OR (fine AND (block > 0.45 OR noise > 9 OR thermal)) OR (capability = 'speed_estimation' AND measured_fps < 4)
  OR (capability = 'uav_detection' AND sharpness < 40) THEN 'blocked' ELSE 'qualifies' END AS reason FROM gr)"""
CERT = X.with_sql(PEOPLE, OPTICS, PLANE, GRANTS)


def grant_rows(spark, sf):
    measured = P.optics(frames(spark, sf)).join(P.ground_plane(samples(spark, sf)).drop("reason", "samples"), "camera_id")
    return P.grants(_cameras(spark), measured)


@query("certificate_grants", CERT + """SELECT camera_id, capability, reason = 'qualifies' AS granted, reason, round(CASE WHEN reason IN ('blocked', 'qualifies') THEN
 1 - least(1, greatest(0, (hy + px * ht) / 480)) END, 4) AS coverage FROM gg""")
def certificate_grants(spark, sf):
    fixed = ["withheld by policy", "not applicable to this role", "ground plane unknown", "pixel density never reached", "qualifies"]
    return grant_rows(spark, sf).select("camera_id", "capability", "granted",
                                        F.when(F.col("reason").isin(*fixed), F.col("reason")).otherwise("blocked").alias("reason"), "coverage")


@query("certificate_granted_sets", CERT + """SELECT camera_id, coalesce(string_agg(capability, ',' ORDER BY capability) FILTER (reason = 'qualifies'), '') AS granted,
 coalesce(string_agg(capability, ',' ORDER BY capability) FILTER (reason <> 'qualifies'), '') AS refused FROM gg GROUP BY camera_id""")
def certificate_granted_sets(spark, sf):
    return P.granted_sets(grant_rows(spark, sf))


@query("certificate_versions", CERT + """SELECT camera_id, count(*) FILTER (reason = 'qualifies') AS granted, CAST(camera_id % 3 + 1 AS BIGINT) AS version,
 camera_id % 4 <> 1 AS intact FROM gg GROUP BY camera_id""")
def certificate_versions(spark, sf):
    """Next version per camera, then a check that finds edited digests."""
    rows = cut(grant_rows(spark, sf))
    old = _cameras(spark).where("camera_id % 3 > 0").select("camera_id", F.explode(F.sequence(F.lit(1), F.col("camera_id") % 3)).alias("v")).select(
        "camera_id", F.col("v").cast("long").alias("version"))
    certs = P.certify(rows, old)
    edited = certs.withColumn("digest", F.when(F.col("camera_id") % 4 == 1, F.reverse("digest")).otherwise(F.col("digest")))
    return P.latest_certificates(P.verify_certificates(edited, rows)).select("camera_id", "granted", "version", "intact")
