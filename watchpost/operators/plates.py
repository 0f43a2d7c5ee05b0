"""Plate reads: gates, best read, throttle and repeat-vehicle patterns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.timefn import is_night_hour
from ..values import DEFAULTS, Params
from .cooldown import suppress_repeats
from .ordered import trailing_distinct

HOUR_US = 3_600_000_000


def accepted_reads(reads: DataFrame, regions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Vehicle reads inside the certified band, wide enough and well formed.

    The geometric gate comes first: it is what decides whether OCR runs at all.
    """
    gated = reads.where(L.is_vehicle(F.col("object_class"))).join(regions, "camera_id")
    gate = L.plate_gate(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "frame_w", "frame_h", "region")])
    return gated.where(gate).where((F.col("plate_px") >= params.plate_px) & T.plate_valid(F.col("raw"))).withColumn(
        "plate", T.plate_spaced(F.col("raw"))).drop("region")


def best_reads(reads: DataFrame) -> DataFrame:
    """Most confident read per track; the earlier one wins a tie."""
    rest = [c for c in reads.columns if c not in ("camera_id", "track_id")]
    rank = F.struct("ocr_confidence", (-F.col("ts_us")).alias("t"), (-F.col("event_id")).alias("e"))
    return reads.groupBy("camera_id", "track_id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select(
        "camera_id", "track_id", "r.*")


def throttle(attempts: DataFrame, params: Params = DEFAULTS, width: int = 1_000_000) -> DataFrame:
    """At least N frames between two attempts on one track."""
    keyed = attempts.withColumn("_track", F.concat_ws(":", "camera_id", F.col("track_id").cast("string")))
    return suppress_repeats(keyed, "_track", "frame", params.plate_attempt_frames, "event_id", width).drop("_track")


def repeat_findings(sightings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Sightings at which a plate shows a pattern within the trailing window.

    Either enough night sightings, or three cameras and enough sightings.
    """
    night = is_night_hour(F.col("ts"), params.night_from, params.night_to)
    t = trailing_distinct(sightings, ["plate"], "camera_id", "ts_us", int(params.plate_window_h * HOUR_US),
                          ["ts_us", "event_id"], "cameras", 24 * HOUR_US,
                          {"sightings": F.lit(1), "night_sightings": night.cast("int")})
    often_at_night = F.col("night_sightings") >= params.plate_sightings
    many_places = (F.col("cameras") >= 3) & (F.col("sightings") >= params.plate_sightings)
    return t.where(often_at_night | many_places).withColumn(
        "pattern", F.when(often_at_night, "night").otherwise("places"))


def summary(sightings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per plate, busiest first."""
    night = is_night_hour(F.col("ts"), params.night_from, params.night_to)
    return sightings.groupBy("plate").agg(
        F.count("*").alias("sightings"), F.array_join(F.array_sort(F.collect_set("camera_id")), ",").alias("cameras"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.when(night, 1)).alias("night_sightings"),
        F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence")).orderBy(F.desc("sightings"), "plate")


def ocr_accuracy(reads: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact matches and character similarity (1 - edit distance / length)."""
    j = reads.join(truth, "event_id")
    a, b = T.plate_key(F.col("raw")), T.plate_key(F.col("truth"))
    return j.groupBy("camera_id").agg(
        F.count("*").alias("reads"), F.count(F.when(a == b, 1)).alias("exact"),
        F.round(F.avg(T.char_similarity(a, b)), 4).alias("char_similarity"))
