"""Camera self-calibration from observed people, and capability certificates."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import dori_density, dori_of_density
from ..values import CAPABILITY_RULES, DEFAULTS, ROLE_CAPABILITIES, Params
from ..session import cut
from .ordered import quantiles
from .slopes import median_lines, median_slope, weighted_median


# --- measurements -------------------------------------------------------------------
def ground_samples(tracks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Observed, settled, unclipped, upright people: (camera, foot row, height)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    whole = (F.col("y2") < F.col("frame_h") - 2) & (F.col("y1") > 1) & (F.col("x1") > 1) & (F.col("x2") < F.col("frame_w") - 2)
    aspect = h / F.nullif(w, F.lit(0.0))
    upright = F.coalesce(aspect.between(params.aspect_min, params.aspect_max), w <= 0)
    return tracks.where((F.col("object_class") == "person") & (F.col("lost_frames") == 0) & (F.col("hits") >= 5)
                        & whole & (h >= 8.0) & upright).withColumns({"foot_v": F.col("y2"), "px_height": h})


def optics(frames: DataFrame) -> DataFrame:
    """Delivered frame rate, median image quality and its plain-text notes."""
    q = quantiles(frames, ["camera_id"], {
        "sharpness": ("sharpness", 0.5), "effective_resolution": ("eff_res", 0.5),
        "blockiness": ("blockiness", 0.5), "noise_sigma": ("noise", 0.5)})
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    m = frames.groupBy("camera_id").agg(
        F.count("*").alias("frames"), F.max("claimed_fps").alias("claimed_fps"), F.avg("luma").alias("mean_luma"),
        F.when((F.count("*") >= 3) & (span > 1e-6), (F.count("*") - 1) / F.nullif(span, F.lit(0.0))).otherwise(0.0).alias("measured_fps"),
        F.max("frame_w").alias("frame_w"), F.max("frame_h").alias("frame_h")).join(q, "camera_id")
    slow = (F.col("claimed_fps") > 0) & (F.col("measured_fps") > 0) & (
        1.0 - F.col("measured_fps") / F.nullif("claimed_fps", F.lit(0.0)) > 0.25)
    m = m.withColumn("is_low_light", F.col("mean_luma") < 55.0)
    return m.withColumn("notes", F.array_compact(F.array(
        F.when(slow, F.lit("frame rate well below claim")),
        F.when(F.col("effective_resolution") < 0.06, F.lit("far less detail than the frame size implies")),
        F.when(F.col("blockiness") > 0.35, F.lit("heavy block artifacts")),
        F.when(F.col("noise_sigma") > 8.0, F.lit("high sensor noise")),
        F.when(F.col("is_low_light"), F.lit("low-light scene")))))


def leverage(samples: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Do the samples span enough depth to place a horizon?"""
    q = quantiles(samples, ["camera_id"], {"v_lo": ("foot_v", 0.05), "v_hi": ("foot_v", 0.95),
                                           "p_lo": ("px_height", 0.05), "p_hi": ("px_height", 0.95)})
    n = samples.groupBy("camera_id").agg(F.count("*").alias("samples"), F.max("frame_h").alias("frame_h"))
    j = n.join(q, "camera_id")
    spread = (F.col("v_hi") - F.col("v_lo") >= 0.10 * F.col("frame_h")) & (
        F.col("p_hi") / F.greatest(F.col("p_lo"), F.lit(1e-6)) >= 1.6)
    return j.withColumn("has_leverage", spread)


def readiness(frames: DataFrame, lever: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Ready once geometry can be fitted, or when the deadline has passed."""
    f = frames.groupBy("camera_id").agg(F.count("*").alias("frames"))
    j = f.join(lever.select("camera_id", "samples", "has_leverage"), "camera_id", "left")
    fit = (F.coalesce("samples", F.lit(0)) >= params.min_ground) & F.coalesce("has_leverage", F.lit(False))
    return j.withColumn("ready", (F.col("frames") >= params.min_frames) & (
        fit | (F.col("frames") >= params.min_frames * params.deadline_factor)))


def line_fit(samples: DataFrame, params: Params = DEFAULTS, task_points: int = 500_000) -> DataFrame:
    """Median of the slopes of all pairs of samples, then median intercept, per camera.

    Samples are first counted by (foot row, height) with partial sums, so repeats on the pixel
    grid cost nothing.  No pair is listed: for a trial slope the pairs that are no steeper
    are counted, and bisection closes in on the middle one to the last bits.  A camera of at
    most ``task_points`` different points is bisected within a task; a larger one in jobs that
    count over all of the cluster (``slopes.median_lines``).  Both count every pair.
    """
    points = cut(samples.where("foot_v IS NOT NULL AND px_height IS NOT NULL").groupBy("camera_id", "foot_v", "px_height").agg(F.count("*").alias("n")))
    large = points.groupBy("camera_id").count().where(F.col("count") > task_points).select("camera_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["foot_v", "px_height"], kind="stable")
        x, y, n = p["foot_v"].to_numpy(float), p["px_height"].to_numpy(float), p["n"].to_numpy(np.int64)
        slope = median_slope(x, y, n)
        out = pd.DataFrame({"camera_id": p["camera_id"].iloc[:1]})
        return out.assign(slope=slope, intercept=weighted_median(y - slope * x, n)) if slope is not None else out.iloc[:0].assign(slope=0.0, intercept=0.0)
    kind = samples.schema["camera_id"].dataType.simpleString()
    small = points.join(large, "camera_id", "left_anti").groupBy("camera_id").applyInPandas(fit, f"camera_id {kind}, slope double, intercept double")
    if large.isEmpty():
        return small
    return small.unionByName(median_lines(points.join(large, "camera_id", "left_semi"), task_points))


def ground_plane(samples: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Horizon, mounting height and pixels per metre, or why there are none."""
    lever = leverage(samples, params)
    f = lever.join(line_fit(samples, params), "camera_id", "left")
    height = params.person_height_m / F.nullif("slope", F.lit(0.0))
    horizon = -F.col("intercept") / F.nullif("slope", F.lit(0.0))
    few = F.col("samples") < max(8, params.min_ground // 3)
    why = (F.when(few, "too few observations").when(~F.col("has_leverage"), "too little depth variation")
           .when(F.col("slope").isNull() | (F.col("slope") <= 1e-6), "non-physical slope")
           .when(~height.between(0.8, 40.0), "implausible camera height"))
    f = f.withColumns({"reason": why, "_h": height, "_y": horizon})
    ok = F.col("reason").isNull()
    near = F.greatest(F.lit(0.0), (F.col("frame_h") - 1 - F.col("_y")) / F.col("_h"))
    far = F.greatest(F.lit(0.0), 0.15 * (F.col("frame_h") - F.col("_y")) / F.col("_h"))
    return f.select("camera_id", "samples", ok.alias("ground_plane"), "reason", F.when(ok, F.round("_y", 1)).alias("horizon_y"),
                    F.when(ok, F.col("_h")).alias("camera_height_m"),
                    F.when(ok, F.round(near, 2)).otherwise(0.0).alias("ppm_near"),
                    F.when(ok, F.round(far, 2)).otherwise(0.0).alias("ppm_far"))


# --- certificates ------------------------------------------------------------------------
def _rules(spark: SparkSession) -> DataFrame:
    rows = [(cap, band, fine, role) for cap, band, fine in CAPABILITY_RULES
            for role in ROLE_CAPABILITIES]
    return spark.createDataFrame(
        [(cap, band, fine, role, cap in ROLE_CAPABILITIES[role]) for cap, band, fine, role in rows],
        "capability string, dori_required string, fine boolean, role string, wanted boolean")


def grants(cameras: DataFrame, measured: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per camera and capability: granted or not, why, and where.

    ``cameras``: camera_id, role, sensor_type.  ``measured``: optics joined with
    ground_plane.  The rule table is a fixed 11 capabilities by 4 roles.
    """
    c = F.col
    j = cameras.join(measured, "camera_id").join(_rules(cameras.sparkSession), "role")
    height = (c("frame_h") - 1 - c("horizon_y")) / F.nullif("ppm_near", F.lit(0.0))
    need = dori_density(c("dori_required"))
    row = c("horizon_y") + need * height
    known = c("ground_plane") & F.coalesce(height > 0, F.lit(False))
    floor = F.when(c("fine"), params.fine_resolution).otherwise(params.coarse_resolution)
    fps = F.coalesce(F.nullif("measured_fps", F.lit(0.0)), c("claimed_fps"))
    blockers = F.array_compact(F.array(
        F.when(c("effective_resolution") < floor, F.lit("effective resolution")),
        F.when(c("fine") & (c("blockiness") > params.max_blockiness), F.lit("block artifacts")),
        F.when(c("fine") & (c("noise_sigma") > params.max_noise), F.lit("noise floor")),
        F.when(c("fine") & (c("sensor_type") == "thermal"), F.lit("thermal sensor")),
        F.when((c("capability") == "speed_estimation") & (fps < params.min_speed_fps), F.lit("frame rate")),
        F.when((c("capability") == "uav_detection") & (c("sharpness") < params.min_uav_sharpness), F.lit("sharpness"))))
    j = j.withColumns({"_row": F.greatest(F.lit(0.0), row), "_known": known, "_never": row >= c("frame_h"),
                       "blockers": blockers})
    reason = (F.when(c("capability") == "face_recognition", "withheld by policy")
              .when(~c("wanted"), "not applicable to this role").when(~c("_known"), "ground plane unknown")
              .when(c("_never"), "pixel density never reached").when(F.size("blockers") > 0, F.array_join("blockers", "; "))
              .otherwise("qualifies"))
    j = j.withColumn("reason", reason)
    top = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("_row") / F.greatest(F.lit(1), c("frame_h"))))
    band = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    geometric = c("wanted") & c("_known") & ~c("_never") & (c("capability") != "face_recognition")
    return j.select("camera_id", "capability", (c("reason") == "qualifies").alias("granted"), "reason", "dori_required",
                    F.when(c("wanted") & c("_known"), dori_of_density(c("ppm_near"))).alias("dori_achieved"),
                    F.when(geometric, F.array(band(0.0, top), band(1.0, top), band(1.0, F.lit(1.0)),
                                              band(0.0, F.lit(1.0)))).alias("valid_region"),
                    F.when(geometric, F.round(1.0 - top, 4)).alias("coverage"))


def certify(grant_rows: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Digest of each camera's grants (11 rows) and the next version number."""
    body = F.to_json(F.struct("capability", "granted", "reason", "dori_required", "dori_achieved"),
                     {"ignoreNullFields": "false"})
    cert = grant_rows.groupBy("camera_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(body)), ","), 256).alias("digest"),
        F.count(F.when(F.col("granted"), 1)).alias("granted"))
    if versions is None:
        return cert.withColumn("version", F.lit(1).cast("long"))
    last = versions.groupBy("camera_id").agg(F.max("version").alias("_v"))
    return cert.join(last, "camera_id", "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def verify_certificates(certs: DataFrame, grant_rows: DataFrame) -> DataFrame:
    again = certify(grant_rows).select("camera_id", F.col("digest").alias("_again"))
    return certs.join(again, "camera_id", "left").withColumn(
        "intact", F.coalesce(F.col("digest") == F.col("_again"), F.lit(False))).drop("_again")


def latest_certificates(certs: DataFrame) -> DataFrame:
    rest = [c for c in certs.columns if c != "camera_id"]
    return certs.groupBy("camera_id").agg(F.max_by(F.struct(*rest), "version").alias("c")).select("camera_id", "c.*")


def granted_sets(grant_rows: DataFrame) -> DataFrame:
    """Granted and refused capabilities per camera as sorted lists."""
    pick = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("capability")))), ",")
    return grant_rows.groupBy("camera_id").agg(pick(F.col("granted")).alias("granted"), pick(~F.col("granted")).alias("refused"))


def height_error(planes: DataFrame, truth: DataFrame) -> DataFrame:
    """Recovered against known mounting height, in percent."""
    return planes.join(truth, "camera_id").select(
        "camera_id", "true_height_m", "camera_height_m",
        (F.abs(F.col("camera_height_m") - F.col("true_height_m")) / F.col("true_height_m") * 100).alias("height_error_percent"))
