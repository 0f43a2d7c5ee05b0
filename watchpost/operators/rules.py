"""Zone and line rules: track points in, event candidates out.

Track points need ``camera_id, track_id, ts_us, event_id, x, y, object_class``
with ``x, y`` the foot point in 0..1 image space.  Candidates all share
``CANDIDATE`` columns, so any rule set can be united.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..session import cut
from ..values import DEFAULTS, Params
from .ordered import (beside, dealt, earliest, lags, neighbours, running, trailing_distinct, with_chunks)

TRACK = ["camera_id", "track_id"]
VISIT = ["camera_id", "track_id", "zone_id"]
ORDER = ["ts_us", "event_id"]
CANDIDATE = ["camera_id", "track_id", "zone_id", "event_type", "event_id", "ts_us", "object_class",
             "confidence", "extra", "group_size", "near_boundary", "dedupe_key"]
SECOND_US = 1_000_000
WIDTH_US = 30 * 86_400 * SECOND_US


def _candidates(df: DataFrame, event_type: Column, key: Column, extra: Column | None = None,
                group_size: Column | None = None, near: bool = False) -> DataFrame:
    cols = {
        "event_type": event_type,
        "extra": F.coalesce(extra, F.lit(0.0)) if extra is not None else F.lit(0.0),
        "group_size": (group_size if group_size is not None else F.lit(1)).cast("long"),
        "near_boundary": F.lit(near),
        "dedupe_key": key,
    }
    for name, kind in (("zone_id", "string"), ("track_id", "long"), ("object_class", "string"),
                       ("confidence", "double")):
        if name not in df.columns:
            cols[name] = F.lit(None).cast(kind)
    return df.withColumns(cols).select(*CANDIDATE)


def _key(*parts) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") if p in ("camera_id", "track_id", "zone_id")
                              else F.lit(p) for p in parts])


# --- track features -----------------------------------------------------------
def track_features(points: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Hits, heading, dwell, path and displacement at every observed point.

    Heading looks back eight points (or to the first); dwell and the path run
    over the bounded history a tracker keeps.
    """
    p = with_chunks(points, TRACK, "ts_us", WIDTH_US)
    p = neighbours(p, TRACK, ORDER, back={"_px": "x", "_py": "y"})
    step = F.sqrt(F.pow(F.col("x") - F.col("_px"), 2) + F.pow(F.col("y") - F.col("_py"), 2))
    p = p.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    p = running(p, TRACK, ORDER, {
        "hits": ("count", F.lit(True)), "_cum": ("sum", "_step"),
        "_f": ("first", F.struct("ts_us", "x", "y"))})
    p = lags(p, TRACK, ORDER, {
        "_h": (F.struct("x", "y"), 8), "_d": (F.col("ts_us"), params.history - 1),
        "_t": (F.struct("x", "y", "_cum"), params.trail - 1)})
    from_x, from_y = F.coalesce(F.col("_h.x"), F.col("_f.x")), F.coalesce(F.col("_h.y"), F.col("_f.y"))
    trail_x, trail_y = F.coalesce(F.col("_t.x"), F.col("_f.x")), F.coalesce(F.col("_t.y"), F.col("_f.y"))
    return p.withColumns({
        "direction_deg": G.heading_deg(from_x, from_y, F.col("x"), F.col("y")),
        "dwell_s": (F.col("ts_us") - F.coalesce(F.col("_d"), F.col("_f.ts_us"))) / 1e6,
        "path_len": F.col("_cum") - F.coalesce(F.col("_t._cum"), F.lit(0.0)),
        "displacement": F.sqrt(F.pow(F.col("x") - trail_x, 2) + F.pow(F.col("y") - trail_y, 2)),
    }).drop("_px", "_py", "_step", "_cum", "_f", "_h", "_d", "_t", "_chunk")


# --- zone membership -----------------------------------------------------------
def zone_readings(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Every point against every enabled polygon of its camera (foot point)."""
    walkable = zones.where(
        "enabled AND size(points) >= 3 AND (kind = 'polygon' OR is_lawful_route)")
    j = points.join(beside(walkable.drop("enabled")), "camera_id")
    return j.withColumn("inside", G.point_in_polygon(F.col("x"), F.col("y"), F.col("points"))).drop("points")


def membership(points: DataFrame, zones: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Zone membership that only flips after N consecutive opposite readings.

    A reading is *settled* when the last N agree; the state is the latest settled
    reading.  Adds ``in_zone``, ``entered`` (this row flipped it on) and
    ``entry_us`` (time of the entry still in force).
    """
    need = params.confirm_frames
    if "hits" not in points.columns and not points.isStreaming:  # features are dealt already
        spread = dealt(points, TRACK, points.count())
    else:
        spread = points
    r = with_chunks(zone_readings(spread, zones), VISIT, "ts_us", WIDTH_US, bound=(points, TRACK))
    agree = F.lit(True)
    if need > 1:
        r = lags(r, VISIT, ORDER, {f"_r{i}": ("inside", i) for i in range(1, need)})
        for i in range(1, need):
            agree = agree & F.coalesce(F.col(f"_r{i}") == F.col("inside"), F.lit(False))
    r = running(r, VISIT, ORDER, {"_state": ("last", F.when(agree, F.col("inside")))})
    r = r.withColumn("in_zone", F.coalesce(F.col("_state"), F.lit(False)))
    r = neighbours(r, VISIT, ORDER, back={"_was": "in_zone"})
    r = r.withColumn("entered", F.col("in_zone") & ~F.coalesce(F.col("_was"), F.lit(False)))
    r = running(r, VISIT, ORDER, {"_entry": ("last", F.when(F.col("entered"), F.col("ts_us")))})
    return (r.withColumn("entry_us", F.when(F.col("in_zone"), F.col("_entry")))
            .drop("_state", "_was", "_entry", "_chunk", *[f"_r{i}" for i in range(1, need)]))


# --- single rules ---------------------------------------------------------------
def intrusions(members: DataFrame) -> DataFrame:
    """First confirmed presence of a track in a restricted polygon."""
    hit = members.where("in_zone AND kind = 'polygon' AND NOT is_lawful_route")
    first = earliest(hit.select(*VISIT, *ORDER, "object_class", "confidence"), VISIT, ORDER)
    kind = F.when(L.is_vehicle(F.col("object_class")), "vehicle_movement").otherwise("zone_intrusion")
    return _candidates(first, kind, _key("camera_id", "track_id", "intrude", "zone_id"))


def line_crossings(points: DataFrame, zones: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """First side change of a track across a tripwire, read only clear of it."""
    wires = zones.where("enabled AND kind = 'line' AND size(points) >= 2").select(
        "camera_id", "zone_id", "points")
    j = points.join(beside(wires), "camera_id")
    x, y, pts = F.col("x"), F.col("y"), F.col("points")
    j = j.where(G.distance_to_polyline(x, y, pts) >= params.line_margin).withColumn(
        "side", G.side_of_line(x, y, F.get(pts, F.lit(0)), F.get(pts, F.lit(1)))).drop("points")
    j = neighbours(with_chunks(j, VISIT, "ts_us", WIDTH_US, bound=(points, TRACK)), VISIT, ORDER, back={"_was": "side"})
    crossed = j.where("_was IS NOT NULL AND side <> 0 AND _was <> 0 AND side <> _was")
    first = earliest(crossed.select(*VISIT, *ORDER, "object_class", "confidence", "side"), VISIT, ORDER)
    return _candidates(first, F.lit("line_crossing"), _key("camera_id", "track_id", "cross", "zone_id"),
                       extra=F.when(F.col("side") < 0, 0.10).otherwise(0.0), near=True)


def wrong_direction(members: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Moving against the flow a zone declares; needs certified direction."""
    m = members.where("in_zone AND kind = 'polygon' AND NOT is_lawful_route AND direction_granted "
                      "AND zone_deg IS NOT NULL AND direction_deg IS NOT NULL")
    against = m.where(G.angular_difference(F.col("direction_deg"), F.col("zone_deg")) > F.col("tolerance"))
    first = earliest(against.select(*VISIT, *ORDER, "object_class", "confidence"), VISIT, ORDER)
    return _candidates(first, F.lit("wrong_direction"), _key("camera_id", "track_id", "wrongdir", "zone_id"))


def off_route(points: DataFrame, zones: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """First point of an established track far from every lawful route."""
    routes = zones.where("enabled AND (kind = 'route' OR is_lawful_route)").select(
        "camera_id", "zone_id", "points")
    j = points.where(F.col("hits") >= params.off_route_hits).join(beside(routes), "camera_id")
    j = j.withColumn("_off", G.off_route_distance(F.col("x"), F.col("y"), F.col("points")))
    near = j.groupBy(*TRACK, *ORDER, "object_class", "confidence").agg(
        F.min(F.struct("_off", "zone_id")).alias("_n"))
    away = near.where(F.col("_n._off") >= params.off_route).select(
        *TRACK, *ORDER, "object_class", "confidence", F.col("_n._off").alias("_off"),
        F.col("_n.zone_id").alias("zone_id"))
    first = earliest(away, TRACK, ORDER)
    return _candidates(first, F.lit("off_route_movement"), _key("camera_id", "track_id", "offroute"),
                       extra=F.round(F.least(F.lit(0.15), F.col("_off") * 0.4), 3))


def loitering(members: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Still inside a zone at least the threshold after the confirmed entry."""
    stay = (F.col("ts_us") - F.col("entry_us")) >= int(params.loiter_s * SECOND_US)
    m = members.where(F.col("in_zone") & stay)
    first = earliest(m.select(*VISIT, *ORDER, "object_class", "confidence"), VISIT, ORDER)
    return _candidates(first, F.lit("loitering"), _key("camera_id", "track_id", "loiter", "zone_id"))


def group_movement(members: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """At least N entries of a restricted zone within the window, at each entry."""
    entries = members.where("entered AND kind = 'polygon' AND NOT is_lawful_route").select(
        "camera_id", "zone_id", "track_id", *ORDER, "object_class", "confidence")
    t = trailing_distinct(entries, ["camera_id", "zone_id"], "track_id", "ts_us",
                          int(params.group_window_s * SECOND_US), ["ts_us", "event_id"],
                          "members", WIDTH_US, {"entries": F.lit(1)})
    t = t.where(F.col("entries") >= params.group_size)
    return _candidates(t, F.lit("group_movement"), _key("camera_id", "group", "zone_id"),
                       group_size=F.col("members"))


def night_movement(points: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    first = earliest(points.where(F.col("is_night") & (F.col("hits") >= params.night_hits)).select(
        *TRACK, *ORDER, "object_class", "confidence"), TRACK, ORDER)
    return _candidates(first, F.lit("night_movement"), _key("camera_id", "track_id", "night"))


def suspicious_movement(points: DataFrame, params: Params = DEFAULTS, path_floor: float = 0.3) -> DataFrame:
    """A long path that goes nowhere, judged once at the first eligible point.

    The path is measured in image space (0..1).  Pass points scaled to pixels to
    get the looser pixel reading.
    """
    first = earliest(points.where(F.col("hits") >= params.suspicious_hits).select(
        *TRACK, *ORDER, "object_class", "confidence", "hits", "path_len", "displacement"), TRACK, ORDER)
    erratic = first.where((F.least(F.col("hits"), F.lit(params.trail)) > params.suspicious_history)
                          & (F.col("path_len") > path_floor)
                          & (F.col("displacement") < F.col("path_len") * 0.3))
    return _candidates(erratic, F.lit("suspicious_activity"), _key("camera_id", "track_id", "suspicious"),
                       extra=F.lit(0.2))


def evaluate(points: DataFrame, zones: DataFrame, cameras: DataFrame,
             params: Params = DEFAULTS) -> DataFrame:
    """All rules, with the doctrine of each camera: fenced or open border."""
    site = cameras.select("camera_id", "profile", "is_night", "direction_granted")
    # both tables feed several rules: compute them once, not once per rule
    pts = cut(track_features(points, params).join(site, "camera_id"))
    members = cut(membership(pts, zones, params))
    fenced, open_ = pts.where("profile = 'fenced'"), pts.where("profile <> 'fenced'")
    fenced_members = members.where("profile = 'fenced'")
    sets = [line_crossings(fenced, zones, params), intrusions(fenced_members),
            wrong_direction(fenced_members, params), off_route(open_, zones, params),
            loitering(members, params), night_movement(pts, params),
            suspicious_movement(pts, params), group_movement(members, params)]
    return reduce(DataFrame.unionByName, sets)
