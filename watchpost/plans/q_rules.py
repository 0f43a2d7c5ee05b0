"""Queries for track features, zone and line rules, doctrine and cooldown."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators.cooldown import suppress_repeats
from ..operators.ordered import beside
from ..values import Params
from . import fixtures as X
from .registry import query

# sparse synthetic tracks: wider windows than the deployed defaults, same rules
TUNED = Params(confirm_frames=2, group_window_s=43_200.0, loiter_s=86_400.0, off_route_hits=4,
               night_hits=3, suspicious_hits=8, suspicious_history=5, trail=6, history=9)

FEATURES = """hist AS (SELECT *, row_number() OVER w AS hits,
 sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step,
 first_value(x) OVER w8 AS hx, first_value(y) OVER w8 AS hy,
 first_value(ts_us) OVER w9 AS dt, first_value(x) OVER w6 AS tx, first_value(y) OVER w6 AS ty
 FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id),
  w8 AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
  w9 AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
  w6 AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
feat AS (SELECT h.*, CASE WHEN abs(x - hx) < 1e-9 AND abs(y - hy) < 1e-9 THEN NULL
   ELSE (degrees(atan2(-(y - hy), x - hx)) + 360e0) % 360e0 END AS direction_deg,
 (ts_us - dt) / 1e6 AS dwell_s,
 coalesce(sum(step) OVER (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id
   ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)
  - CASE WHEN hits > 0 THEN 0 ELSE 0 END AS path_len,
 sqrt(pow(x - tx, 2) + pow(y - ty, 2)) AS displacement FROM hist h)"""

MEMBERS = f"""readings AS (SELECT f.*, z.zone_id, z.kind, z.zone_deg, z.tolerance, z.is_lawful_route,
  c.profile, c.is_night, c.direction_granted, {X.sql_inside('x', 'y', 'points')} AS inside
 FROM feat f JOIN zones z USING (camera_id) JOIN cams c USING (camera_id)
 WHERE z.enabled AND len(points) >= 3 AND (kind = 'polygon' OR is_lawful_route)),
runs AS (SELECT *, CASE WHEN inside = lag(inside) OVER v THEN inside END AS settled FROM readings
 WINDOW v AS (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id)),
stated AS (SELECT *, coalesce(last_value(settled IGNORE NULLS) OVER v, FALSE) AS in_zone FROM runs
 WINDOW v AS (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flips AS (SELECT *, in_zone AND NOT coalesce(lag(in_zone) OVER v, FALSE) AS entered FROM stated
 WINDOW v AS (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id)),
members AS (SELECT *, CASE WHEN in_zone THEN last_value(CASE WHEN entered THEN ts_us END IGNORE NULLS) OVER v END
  AS entry_us FROM flips WINDOW v AS (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

BASE = X.with_sql(X.OBS, X.ZONES, X.CAMS, FEATURES, MEMBERS)
SHOWN = ["camera_id", "track_id", "zone_id", "event_type", "event_id", "dedupe_key", "extra", "group_size"]


def _watched(spark, sf, where="TRUE"):
    """Track points of the cameras that a rule looks at, before anything is worked out over them."""
    site = X.cameras(spark).where(where).select("camera_id", "profile", "is_night", "direction_granted")
    return X.obs(spark, sf).join(beside(site), "camera_id")


def _points(spark, sf, where="TRUE"):
    return R.track_features(_watched(spark, sf, where), TUNED)


def _members(spark, sf, where="TRUE", zones="TRUE"):
    return R.membership(_points(spark, sf, where), X.zones(spark).where(zones), TUNED)


def fenced_visits(spark, sf):
    """Membership of restricted zones on fenced cameras: all that an intrusion needs."""
    return R.membership(_watched(spark, sf, "profile = 'fenced'"), X.zones(spark).where("kind = 'polygon' AND NOT is_lawful_route"), TUNED)


def _show(cands):
    return cands.select(*SHOWN)


@query("track_features", X.with_sql(X.OBS, FEATURES) + """SELECT event_id, hits,
 round(direction_deg, 4) AS direction_deg, round(dwell_s, 3) AS dwell_s,
 round(path_len, 6) AS path_len, round(displacement, 6) AS displacement FROM feat""")
def track_features(spark, sf):
    f = R.track_features(X.obs(spark, sf), TUNED)
    return f.select("event_id", "hits", F.round("direction_deg", 4).alias("direction_deg"),
                    F.round("dwell_s", 3).alias("dwell_s"), X.r6(F.col("path_len")).alias("path_len"),
                    X.r6(F.col("displacement")).alias("displacement"))


@query("track_class_vote", X.with_sql(X.OBS) + """, votes AS (SELECT event_id,
 count(*) FILTER (object_class = 'car') OVER w AS car, count(*) FILTER (object_class = 'cattle') OVER w AS cattle,
 count(*) FILTER (object_class = 'person') OVER w AS person, count(*) FILTER (object_class = 'truck') OVER w AS truck
 FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CASE greatest(car, cattle, person, truck) WHEN car THEN 'car' WHEN cattle THEN 'cattle'
 WHEN person THEN 'person' ELSE 'truck' END AS voted_class FROM votes""")
def track_class_vote(spark, sf):
    """Majority class of a track so far; ties go to the first name."""
    from ..operators.tracking import class_vote
    return class_vote(X.obs(spark, sf)).select("event_id", "voted_class")


@query("zone_membership", BASE + """SELECT event_id, zone_id, inside, in_zone, entered,
 entry_us FROM members""")
def zone_membership(spark, sf):
    return _members(spark, sf).select("event_id", "zone_id", "inside", "in_zone", "entered", "entry_us")


def _first(event_type: str, where: str, key: str, per: str, extra: str = "0e0", frm: str = "members") -> str:
    return f"""SELECT camera_id, track_id, zone_id, {event_type} AS event_type, event_id,
 {key} AS dedupe_key, {extra} AS extra, CAST(1 AS BIGINT) AS group_size
 FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY ts_us, event_id) AS first_rn
  FROM {frm} WHERE {where}) WHERE first_rn = 1"""


def _ck(tag: str) -> str:
    return f"camera_id || ':' || track_id || ':{tag}:' || zone_id"


RESTRICTED = "in_zone AND kind = 'polygon' AND NOT is_lawful_route AND profile = 'fenced'"
VISIT = "camera_id, track_id, zone_id"
SQL_INTRUSION = _first("CASE WHEN object_class IN ('car','motorcycle','bus','truck') THEN 'vehicle_movement' "
                       "ELSE 'zone_intrusion' END", RESTRICTED, _ck("intrude"), VISIT)
SQL_WRONG = _first("'wrong_direction'", RESTRICTED + """ AND direction_granted AND zone_deg IS NOT NULL
 AND direction_deg IS NOT NULL AND least((direction_deg - zone_deg + 720) % 360e0,
  360 - (direction_deg - zone_deg + 720) % 360e0) > tolerance""", _ck("wrongdir"), VISIT)
SQL_LOITER = _first("'loitering'", "in_zone AND ts_us - entry_us >= 86400000000", _ck("loiter"), VISIT)
CROSS = f""", sides AS (SELECT f.*, z.zone_id, {X.sql_side('x', 'y', 'points')} AS side FROM feat f
  JOIN cams c USING (camera_id) JOIN zones z USING (camera_id)
 WHERE z.enabled AND z.kind = 'line' AND c.profile = 'fenced' AND {X.sql_distance('x', 'y', 'points')} >= 0.012),
crossed AS (SELECT *, lag(side) OVER (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id) AS was
 FROM sides)"""
SQL_CROSS = _first("'line_crossing'", "was IS NOT NULL AND side <> 0 AND was <> 0 AND side <> was",
                   _ck("cross"), VISIT, "CASE WHEN side < 0 THEN 0.1e0 ELSE 0e0 END", "crossed")
OFF = f""", offs AS (SELECT f.*, z.zone_id, CASE WHEN {X.sql_inside('x', 'y', 'points')} THEN 0e0
  ELSE {X.sql_distance('x', 'y', 'points')} END AS off FROM feat f JOIN cams c USING (camera_id)
  JOIN zones z USING (camera_id) WHERE z.enabled AND (z.kind = 'route' OR z.is_lawful_route)
   AND c.profile <> 'fenced' AND f.hits >= 4),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off, zone_id) AS nr
 FROM offs) WHERE nr = 1)"""
SQL_OFF = _first("'off_route_movement'", "off >= 0.1", "camera_id || ':' || track_id || ':offroute'",
                 "camera_id, track_id", "round(least(0.15e0, off * 0.4), 3)", "nearest")
NIGHT = ", lit AS (SELECT f.*, c.is_night, CAST(NULL AS VARCHAR) AS zone_id FROM feat f JOIN cams c USING (camera_id))"
SQL_NIGHT = _first("'night_movement'", "is_night AND hits >= 3", "camera_id || ':' || track_id || ':night'",
                   "camera_id, track_id", frm="lit")
SQL_SUSPECT = "SELECT * EXCLUDE (path_len, displacement, hits) FROM (" + _first(
    "'suspicious_activity'", "hits >= 8", "camera_id || ':' || track_id || ':suspicious'",
    "camera_id, track_id", "0.2e0", "lit").replace(" AS group_size", " AS group_size, path_len, displacement, hits") + \
    ") WHERE least(hits, 6) > 5 AND path_len > 0.3 AND displacement < path_len * 0.3"
SQL_GROUP = """SELECT a.camera_id, a.track_id, a.zone_id, 'group_movement' AS event_type, a.event_id,
 a.camera_id || ':group:' || a.zone_id AS dedupe_key, 0e0 AS extra, count(DISTINCT b.track_id) AS group_size
 FROM members a JOIN members b ON b.camera_id = a.camera_id AND b.zone_id = a.zone_id AND b.entered
  AND b.ts_us BETWEEN a.ts_us - 43200000000 AND a.ts_us AND (b.ts_us, b.event_id) <= (a.ts_us, a.event_id)
 WHERE a.entered AND a.kind = 'polygon' AND NOT a.is_lawful_route
 GROUP BY a.camera_id, a.track_id, a.zone_id, a.event_id HAVING count(*) >= 3"""


@query("rule_zone_intrusion", BASE + SQL_INTRUSION)
def rule_zone_intrusion(spark, sf):
    return _show(R.intrusions(fenced_visits(spark, sf)))


@query("rule_line_crossing", BASE + CROSS + SQL_CROSS)
def rule_line_crossing(spark, sf):
    return _show(R.line_crossings(_points(spark, sf, "profile = 'fenced'"), X.zones(spark), TUNED))


@query("rule_wrong_direction", BASE + SQL_WRONG)
def rule_wrong_direction(spark, sf):
    return _show(R.wrong_direction(_members(spark, sf, "profile = 'fenced'"), TUNED))


@query("rule_off_route", BASE + OFF + SQL_OFF)
def rule_off_route(spark, sf):
    return _show(R.off_route(_points(spark, sf, "profile <> 'fenced'"), X.zones(spark), TUNED))


@query("rule_loitering", BASE + SQL_LOITER)
def rule_loitering(spark, sf):
    return _show(R.loitering(_members(spark, sf), TUNED))


@query("rule_group_movement", BASE + SQL_GROUP)
def rule_group_movement(spark, sf):
    return _show(R.group_movement(_members(spark, sf), TUNED))


@query("rule_night_movement", BASE + NIGHT + SQL_NIGHT)
def rule_night_movement(spark, sf):
    return _show(R.night_movement(_points(spark, sf, "is_night"), TUNED))


@query("rule_suspicious_movement", BASE + NIGHT + SQL_SUSPECT)
def rule_suspicious_movement(spark, sf):
    return _show(R.suspicious_movement(_points(spark, sf), TUNED))


ALL_RULES = BASE + CROSS + OFF + NIGHT + ", cands AS (" + "\nUNION ALL\n".join(
    f"SELECT * FROM ({q})" for q in (SQL_CROSS, SQL_INTRUSION, SQL_WRONG, SQL_OFF, SQL_LOITER, SQL_NIGHT,
                                     SQL_SUSPECT, SQL_GROUP)) + ")"


@query("rules_by_doctrine", ALL_RULES + " SELECT * FROM cands")
def rules_by_doctrine(spark, sf):
    """All rules with the fenced / open doctrine of each camera."""
    return _show(R.evaluate(X.obs(spark, sf), X.zones(spark), X.cameras(spark), TUNED))


@query("rule_cooldown", "WITH RECURSIVE " + X.OBS + """,
cand AS (SELECT camera_id || ':' || object_class AS k, ts_us, event_id FROM obs),
kept(k, ts_us, event_id) AS (
 SELECT k, min(ts_us), arg_min(event_id, (ts_us, event_id)) FROM cand GROUP BY k
 UNION ALL
 SELECT c.k, min(c.ts_us), arg_min(c.event_id, (c.ts_us, c.event_id)) FROM kept p JOIN cand c
  ON c.k = p.k AND c.ts_us >= p.ts_us + 7200000000 GROUP BY c.k)
SELECT k AS dedupe_key, event_id, ts_us FROM kept""")
def rule_cooldown(spark, sf):
    """At most one row per camera and class in any two hours, greedily in time."""
    o = X.obs(spark, sf).select(F.concat_ws(":", "camera_id", "object_class").alias("dedupe_key"),
                                "event_id", "ts_us")
    return suppress_repeats(o, "dedupe_key", "ts_us", 2 * X.HOUR_US, "event_id", 90 * X.DAY_US)
