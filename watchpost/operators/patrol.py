"""Patrol conformance: does a declared friendly movement explain an event?"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angular_difference
from ..functions.labels import priority_of_score, priority_rank
from ..functions.text import plate_key
from ..functions.timefn import local_time, minutes_outside, window_occurrence
from ..values import DEFAULTS, Params
from .ordered import running, with_chunks

WINDOW = "struct<days:array<int>,start:int,end:int,tolerance:int>"
PROFILE_SCHEMA = (
    "patrol_id string, patrol_name string, active boolean, cameras array<string>, zones array<string>, "
    f"windows array<{WINDOW}>, expected_heading double, heading_tolerance double, classes array<string>, "
    "max_group int, min_speed double, max_speed double, identity_enabled boolean, plates array<string>, "
    "max_suppressions int, roster_pos int")
DAY_US = 86_400_000_000


def candidates(observations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active profiles on the event's camera and class, not ruled out by a plate."""
    on_camera = profiles.where("active").select(
        F.explode(F.array_distinct("cameras")).alias("camera_id"),
        *[F.col(c).alias(f"p_{c}") for c in profiles.columns])
    j = observations.join(on_camera, "camera_id")
    allowed = (F.size("p_classes") == 0) | F.array_contains("p_classes", F.col("object_class"))
    other = (F.col("p_identity_enabled") & (F.size("p_plates") > 0) & F.col("plate").isNotNull()
             & (F.col("plate") != "")
             & ~F.array_contains(F.transform("p_plates", plate_key), plate_key(F.col("plate"))))
    return j.where(allowed & ~F.coalesce(other, F.lit(False)))


def _weighted(parts) -> Column:
    earned = possible = F.lit(0.0)
    for score, weight, usable in parts:
        earned = earned + F.when(usable, score * weight).otherwise(0.0)
        possible = possible + F.when(usable, F.lit(weight)).otherwise(0.0)
    return F.coalesce(earned / F.nullif(possible, F.lit(0.0)), F.lit(0.0))


def cues(cand: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Schedule gate and the five cue scores of every (event, profile) pair."""
    local = local_time(F.col("ts"), time_zone) if time_zone != "UTC" else F.col("ts")
    c = cand.withColumn("_local", local)
    gaps = F.transform("p_windows", lambda w, i: F.struct(
        minutes_outside(F.col("_local"), w["days"], w["start"], w["end"]).alias("gap"), i.alias("i"), w.alias("w")))
    c = c.withColumn("_win", F.when(F.size("p_windows") > 0, F.array_min(F.transform(
        gaps, lambda g: F.struct(g["gap"].alias("gap"), g["i"].alias("i"), g["w"]["start"].alias("start"),
                                 g["w"]["end"].alias("end"), g["w"]["tolerance"].alias("tolerance"))))))
    has_window, gap = F.col("_win").isNotNull(), F.col("_win.gap")
    tolerance = F.greatest(F.lit(1), F.col("_win.tolerance"))
    c = c.where(~has_window | (gap <= tolerance))

    zones, zone = F.col("p_zones"), F.col("zone_id")
    declares_here = F.exists("p_zones", lambda z: z.startswith(F.col("camera_id")))
    in_zone = F.coalesce(F.array_contains(zones, zone), F.lit(False))
    zone_known = (F.size(zones) > 0) & zone.isNotNull()

    want, tol = F.col("p_expected_heading"), F.greatest(F.lit(1.0), F.col("p_heading_tolerance"))
    diff = angular_difference(F.col("heading_deg"), want)
    facing = want.isNotNull() & F.col("heading_deg").isNotNull()

    trail = F.filter(F.coalesce("trail", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    c = c.withColumn("_trail", trail)
    places = F.filter(F.transform("_trail", lambda t: F.array_position(F.col("p_cameras"), t)), lambda p: p > 0)
    c = c.withColumn("_known", places)
    n, hops = F.size("_known"), F.size("_known") - 1
    forward = F.aggregate(F.sequence(F.lit(1), F.greatest(hops, F.lit(1))), F.lit(0), lambda a, i: a + F.when(
        F.get(F.col("_known"), i) > F.get(F.col("_known"), i - 1), 1).otherwise(0))
    straight = forward / F.nullif(hops, F.lit(0)) * (
        1.0 - (F.size("_trail") - n) / F.nullif(F.size("_trail"), F.lit(0)))
    routed = (F.size("_trail") >= 2) & (F.size("p_cameras") >= 2)

    speed, fast = F.col("speed_mps"), F.col("p_max_speed")
    too_many = F.col("group_size") > F.col("p_max_group")
    runaway = F.coalesce(speed > fast * 2.0, F.lit(False))
    off_pace = F.coalesce(~speed.between(F.col("p_min_speed"), fast), F.lit(False))

    return c.withColumns({
        "on_schedule": F.coalesce(gap == 0.0, F.lit(False)),
        "has_window": has_window,
        "time_score": F.when(~has_window, 0.0).when(gap == 0.0, 1.0).otherwise(
            F.greatest(F.lit(0.0), 1.0 - gap / tolerance)),
        "zone_score": F.when(zone_known & in_zone, 1.0).otherwise(0.0),
        "zone_known": zone_known,
        "off_route": zone_known & ~in_zone & declares_here,
        "direction_score": F.when(facing, F.greatest(F.lit(0.0), 1.0 - diff / tol)).otherwise(0.0),
        "direction_known": facing,
        "opposed": F.coalesce(facing & (diff >= 90.0) & (diff > tol), F.lit(False)),
        "route_score": F.when(routed & (n >= 2), straight).otherwise(0.0),
        "route_known": routed,
        "movement_score": F.greatest(F.lit(0.0), 1.0 - F.when(too_many, 0.5).otherwise(0.0)
                                     - F.when(runaway, 0.5).when(off_pace, 0.25).otherwise(0.0)),
        "over_strength": too_many, "runaway": runaway,
        "occurrence": F.when(has_window, window_occurrence(
            F.col("p_patrol_id"), F.col("_local"), F.col("_win.start"), F.col("_win.end"))),
    }).drop("_local", "_trail", "_known")


def assess(observations: DataFrame, profiles: DataFrame, params: Params = DEFAULTS,
           time_zone: str = "UTC") -> DataFrame:
    """Best profile per event with its decision; one row per observation.

    The choice of profile never depends on how much suppression budget is left,
    so the budget can be applied afterwards: the first N strong matches of one
    window occurrence are suppressed and later ones only downgraded.
    """
    c = F.col
    s = cues(candidates(observations, profiles), time_zone)
    identity = _weighted([(c("time_score"), 0.60, c("has_window")), (c("route_score"), 0.40, c("route_known"))])
    conform = _weighted([(c("direction_score"), 0.55, c("direction_known")),
                         (c("zone_score"), 0.30, c("zone_known")), (c("movement_score"), 0.15, F.lit(True))])
    s = s.withColumns({"_id": identity, "_cf": conform})
    blend = 0.5 * c("_id") + 0.5 * c("_cf")
    match = F.when(c("on_schedule"), blend).otherwise(F.least(blend, F.lit(params.off_schedule_cap)))
    deviations = F.array_compact(F.array(
        F.when(c("opposed"), F.lit("against the expected direction")),
        F.when(c("off_route"), F.lit("outside the zones of the route")),
        F.when(c("over_strength"), F.lit("more people than the patrol has")),
        F.when(c("runaway"), F.lit("far faster than the patrol moves"))))
    s = s.withColumns({"match_score": F.round(match, 3), "deviations": deviations})
    best = s.groupBy("event_id").agg(F.max_by(
        F.struct(c("p_patrol_id").alias("patrol_id"), "match_score", c("_id").alias("identity_raw"), c("_cf").alias("conformance_raw"),
                 F.round("_id", 3).alias("identity_confidence"), F.round("_cf", 3).alias("conformance"),
                 "deviations", "occurrence", "on_schedule", c("p_max_suppressions").alias("limit")),
        F.struct("match_score", (-c("p_roster_pos")).alias("r"))).alias("b"))
    out = observations.join(best, "event_id", "left").select(observations["*"], "b.*")
    deviant = (c("identity_raw") >= params.deviation_identity) & (F.size("deviations") > 0)
    strong = ~deviant & (c("match_score") >= params.strong_match)
    out = out.withColumn("_strong", F.coalesce(strong, F.lit(False)))

    spend = out.where("_strong").select("event_id", "ts_us", "occurrence", "limit")
    spend = with_chunks(spend, ["occurrence"], "ts_us", DAY_US, bound=(observations, []))
    spend = running(spend, ["occurrence"], ["ts_us", "event_id"], {"_nth": ("count", F.lit(True))})
    within = spend.where(c("_nth") <= c("limit")).select("event_id", F.lit(True).alias("_paid"))
    out = out.join(within, "event_id", "left")
    decision = (F.when(F.coalesce(deviant, F.lit(False)), "deviation")
                .when(c("_strong") & c("_paid"), "suppressed")
                .when(c("_strong"), "downgraded")
                .when(c("match_score") >= params.uncertain_match, "downgraded")
                .otherwise("not_matched"))
    out = out.withColumns({"decision": decision,
                           "budget_exhausted": c("_strong") & c("_paid").isNull()})
    return out.withColumn("adjustment", F.when(c("decision") == "deviation", params.deviation_adjust)
                          .when(c("decision") == "suppressed", params.suppress_adjust)
                          .when(c("decision") == "downgraded", params.downgrade_adjust).otherwise(0.0)
                          ).drop("_strong", "_paid", "limit", "on_schedule")


def apply(assessed: DataFrame) -> DataFrame:
    """Move the score; a deviation never falls below medium; mark the bypass.

    Suppressed events skip the alert governor, so a routine patrol never uses
    budget a real alert would need.
    """
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("adjustment")))
    out = assessed.withColumn("score", F.when(F.abs("adjustment") > 1e-6, moved).otherwise(F.col("score")))
    band = priority_of_score(F.col("score"))
    floor = (F.col("decision") == "deviation") & (priority_rank(band) < 2)
    return out.withColumns({"priority": F.when(floor, "medium").otherwise(band),
                            "to_governor": F.col("decision") != "suppressed"})


def metrics(assessed: DataFrame) -> DataFrame:
    """How many events each decision took, and the share removed from alerts."""
    n = lambda d: F.count(F.when(F.col("decision") == d, 1))
    return assessed.agg(
        F.count("*").alias("raw_events"), F.count(F.when(F.col("decision") != "not_matched", 1)).alias("matched"),
        n("suppressed").alias("suppressed"), n("downgraded").alias("downgraded"), n("deviation").alias("deviations"),
        n("not_matched").alias("unmatched"), F.count(F.when(F.col("budget_exhausted"), 1)).alias("budget_exhausted"),
    ).withColumn("alert_reduction_percent", F.round(
        F.coalesce(100.0 * F.col("suppressed") / F.nullif("raw_events", F.lit(0)), F.lit(0.0)), 1))


def roster_summary(profiles: DataFrame) -> DataFrame:
    """Active and total profiles and the distinct cameras the active ones cover."""
    cams = profiles.select("active", "patrol_id", F.explode_outer("cameras").alias("camera_id"))
    return cams.agg(F.count_distinct(F.when(F.col("active"), F.col("patrol_id"))).alias("active"),
                    F.count_distinct("patrol_id").alias("total"),
                    F.array_join(F.array_sort(F.collect_set(F.when(F.col("active"), F.col("camera_id")))), ",")
                    .alias("cameras_covered"))
